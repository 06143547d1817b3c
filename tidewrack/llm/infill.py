"""Fill-in-middle forms of documents, cut at token boundaries.

A token is a run of blanks and the run of other characters behind it, or the blanks that end a text; so a boundary lies
wherever a blank follows a character that is none, and at a text's end. Texts are taken apart into chunks of CHUNK code points that
overlap by one, and two neighbouring characters decide whether a boundary lies between them: chunks are counted
independently of each other. Prefix sums over a document's chunks give its number of tokens, and route the ranks of
both cuts to the chunks that own them. Only these are read again, to find the place of the cut.

The texts are shuffled once, to meet their cuts; before that one small row for each chunk is. Rows alike in id and text share
their chunks' counts.

Edge cases: a null or empty text has no tokens and stays plain; so does one that holds a marker already; ids may be null
(hashed as an empty number) or repeat; a text of blanks alone is one token; a very long text is one row, and a window orders as
many small rows as it has chunks; other columns, whatever their names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 4096
BLANK = r"\x20\x09-\x0D"
#: Between these two characters a token ends.
BOUNDARY = rf"(?<=[^{BLANK}])(?=[{BLANK}])"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKER = "<[PSM]>"


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2**32 from a hash of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def identified(df: DataFrame) -> DataFrame:
    """(doc_id, text, a, b): null texts are empty; a and b name the row's id and text."""
    named = F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
    text = F.coalesce("text", F.lit(""))
    return df.select("doc_id", text.alias("text"), F.xxhash64(named, text).alias("a"), F.xxhash64(F.lit(13), named, text).alias("b"))


def chunk_counts(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, a, b, k, ends): the boundaries within each chunk of a text; an empty text has no chunks."""
    pieces = rf"(?s)(.{{1,{chunk}}})(?=(.?))"
    parts = F.arrays_zip(F.regexp_extract_all("text", F.lit(pieces), 1).alias("own"), F.regexp_extract_all("text", F.lit(pieces), 2).alias("next"))
    cut = rows.select("doc_id", "a", "b", F.posexplode(parts).alias("k", "part"))
    ends = F.regexp_count(F.concat("part.own", "part.next"), F.lit(BOUNDARY))
    return cut.select("doc_id", "a", "b", "k", ends.cast("long").alias("ends"))


def cuts(counts: DataFrame, seed: int) -> DataFrame:
    """(a, b, n, k1, r1, k2, r2): a text's number of tokens, and for each cut the chunk that owns it and the rank within it.

    The cut before the first token is rank 0 of chunk 0; the one after the last, which no chunk counts, has a null chunk."""
    once = counts.groupBy("a", "b", "k").agg(F.first("ends").alias("ends"), F.first("doc_id").alias("doc_id"))
    text = Window.partitionBy("a", "b")
    before = F.sum("ends").over(text.orderBy("k")) - F.col("ends")
    summed = once.withColumn("before", before).withColumn("n", F.sum("ends").over(text) + 1)
    h1, h2 = draws(F.col("doc_id"), seed)[:2]
    ranked = summed.withColumn("x", h1 % (F.col("n") + 1)).withColumn("y", h2 % (F.col("n") + 1))
    out = []
    for i, rank in enumerate((F.least("x", "y"), F.greatest("x", "y")), 1):
        owns = ((F.col("before") < rank) & (rank <= F.col("before") + F.col("ends"))) | ((rank == 0) & (F.col("k") == 0))
        at = F.max(F.when(owns, F.struct("k", (rank - F.col("before")).alias("r"))))
        out += [at["k"].alias(f"k{i}"), at["r"].alias(f"r{i}")]
    return ranked.groupBy("a", "b").agg(F.max("n").alias("n"), *out)


def place(text: Column, k: Column, rank: Column, chunk: int = CHUNK) -> Column:
    """Code points before the rank-th boundary of chunk k; all of them if k is null. Reads that chunk only."""
    pieces = F.split(F.substring(text, k * chunk + 1, F.lit(chunk + 1)), BOUNDARY, -1)
    within = F.char_length(F.array_join(F.slice(pieces, F.lit(1), rank.cast("int")), ""))
    return F.when(k.isNull(), F.char_length(text)).otherwise(k * chunk + within)


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    parts = F.split(output, MARKER, -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def transform(df: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80, chunk: int = CHUNK) -> DataFrame:
    """Gives (doc_id, n, form, prefix_chars, middle_chars, output) for each row of (doc_id, text).

    rate percent of the documents are cut; of these spm_rate percent start with the suffix."""
    rows = identified(df)
    found = cuts(chunk_counts(rows, chunk), seed).withColumnsRenamed({"a": "of", "b": "same"})
    met = rows.join(found, (F.col("a") == F.col("of")) & (F.col("b") == F.col("same")), "left")
    _, _, h3, h4 = draws(F.col("doc_id"), seed)
    plain = (F.col("text") == "") | F.col("text").rlike(MARKER) | (h3 % 100 >= rate)
    form = F.when(plain, "plain").when(h4 % 100 < spm_rate, "spm").otherwise("psm")
    cut = met.select("doc_id", "text", F.coalesce("n", F.lit(0)).alias("n"), form.alias("form"), *[F.when(~plain, place(F.col("text"), F.col(f"k{i}"), F.col(f"r{i}"), chunk)).cast("long").alias(f"at{i}") for i in (1, 2)])
    at1, at2 = F.col("at1").cast("int"), F.col("at2").cast("int")
    prefix, middle, suffix = F.substring("text", F.lit(1), at1), F.substring("text", at1 + 1, at2 - at1), F.substring("text", at2 + 1, F.char_length("text"))
    psm, spm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle), F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    return cut.select("doc_id", F.col("n").cast("long").alias("n"), "form", F.col("at1").alias("prefix_chars"), (F.col("at2") - F.col("at1")).alias("middle_chars"), output.alias("output"))


def brute_force(doc_id: int | None, text: str | None, seed: int = 42, rate: int = 50, spm_rate: int = 80) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) in plain Python, token by token: for tests."""
    text = text or ""
    tokens = re.findall(rf"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+", text)
    n, digest = len(tokens), hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or re.search(MARKER, text) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:lo]), "".join(tokens[lo:hi]), "".join(tokens[hi:])
    if h4 % 100 < spm_rate:
        return n, "spm", len(prefix), len(middle), f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", len(prefix), len(middle), f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


#: The same token by token.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
n AS (SELECT *, len(t) AS n, list_transform([0, 1, 2, 3], lambda i: CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT)) AS x FROM d),
c AS (SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS lo, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS hi,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR x[3] % 100 >= 50 THEN 'plain' WHEN x[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (SELECT *, array_to_string(t[1 : lo], '') AS prefix, array_to_string(t[lo + 1 : hi], '') AS middle, array_to_string(t[hi + 1 : n], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
