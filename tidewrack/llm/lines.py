"""Removal of lines that many documents share.

Texts are split at line feeds and the lines exploded with their positions. A line's key is the line without blanks at
its ends, with ASCII letters in lower case; two 64-bit hashes with different seeds stand for it. Distinct documents are
counted for each hash, and lines whose key is in `least_documents` or more are dropped, in every document. The positions
that go are gathered for each document, and the other lines are joined again in their order.

No line's text is shuffled but those of whole documents, once, to meet their dropped positions. A key may hold a third of all lines:
keys with more than 1/HOT_SHARE of the counted places, fewer than HOT_SHARE of them whatever the input, are broadcast, so
that only the others meet in a shuffle. Distinct documents are counted by key and document first, then by key.

Edge cases: a null or empty text is one empty line and stays so; keys shorter than `least_chars` are never dropped; a
document is a doc_id, and repeated rows with one id count once; a row with a null id is a document named by its text;
a document that repeats a line counts once; a very long text is one row, and its positions are as many as its lines; other columns, whatever their
names, are not read; an empty table gives no rows; a document all of whose lines go keeps an empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.llm.common import WorkArea, ascii_lower
from tidewrack.llm.mixing import row_name

BLANKS = " \t\n\x0b\x0c\r"
#: Keys with more than this part of the places are broadcast: fewer than HOT_SHARE keys.
HOT_SHARE = 2000


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def split_lines(df: DataFrame) -> DataFrame:
    """(doc_id, name, own, lines): name tells documents apart, own their texts."""
    text = F.coalesce("text", F.lit(""))
    return df.select("doc_id", row_name().alias("name"), F.xxhash64(text).alias("own"), F.split(text, "\n", -1).alias("lines"))


def hashed_lines(df: DataFrame, least_chars: int = 1) -> DataFrame:
    """(name, own, pos, a, b) for every line with a key of least_chars or more; a and b are the key's hashes."""
    key = line_key(F.col("line"))
    rows = split_lines(df).select("name", "own", F.posexplode("lines").alias("pos", "line")).select("name", "own", "pos", key.alias("key"))
    return rows.where(F.char_length("key") >= least_chars).select("name", "own", "pos", F.xxhash64("key").alias("a"), F.xxhash64(F.lit(11), "key").alias("b"))


def shared_keys(lines: DataFrame, least_documents: int = 10) -> DataFrame:
    """(a, b, documents) of the keys found in least_documents documents or more."""
    return lines.select("a", "b", "name").distinct().groupBy("a", "b").agg(F.count("*").alias("documents")).where(F.col("documents") >= least_documents)


def dropped(lines: DataFrame, shared: DataFrame) -> DataFrame:
    """(name, own, drop): the sorted positions of the lines whose key is in `shared`, a written table."""
    places = shared.agg(F.sum("documents")).first()[0] or 0
    # Fewer than HOT_SHARE keys can have more than 1/HOT_SHARE of the sum, so the broadcast has a bound.
    hot = shared.where(F.col("documents") * HOT_SHARE > places).select("a", "b", F.lit(True).alias("hot"))
    met = lines.join(F.broadcast(hot), ["a", "b"], "left")
    others = met.where("hot is null").join(shared.select("a", "b"), ["a", "b"], "left_semi")
    found = met.where("hot").select("name", "own", "pos").union(others.select("name", "own", "pos"))
    return found.distinct().groupBy("name", "own").agg(F.sort_array(F.collect_list("pos")).alias("drop"))


def deduplicate(df: DataFrame, least_documents: int = 10, least_chars: int = 1) -> DataFrame:
    """Gives (doc_id, n_lines, n_dropped, kept) for each row of (doc_id, text): kept is the text without shared lines."""
    work = WorkArea(df.sparkSession, "lines")
    lines = work.write(hashed_lines(df, least_chars), "hashed")
    shared = work.write(shared_keys(lines, least_documents), "shared")
    gone = work.write(dropped(lines, shared), "dropped").withColumnsRenamed({"name": "of", "own": "same"})
    # What is dropped grows with the documents, so it is never broadcast, and the plan is the same at every size.
    met = split_lines(df).join(gone.hint("merge"), (F.col("name") == F.col("of")) & (F.col("own") == F.col("same")), "left")
    # The positions that stay, by a hash set; `lines` is a column of the join and is not split again for each of them.
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "drop")
    kept = F.array_join(F.transform(stay, lambda i: F.col("lines")[i]), "\n")
    n_dropped = F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop"))
    whole = F.array_join("lines", "\n")
    return met.select("doc_id", F.size("lines").cast("long").alias("n_lines"), n_dropped.cast("long").alias("n_dropped"), F.when(F.col("drop").isNull(), whole).otherwise(kept).alias("kept"))


def brute_force(rows: list[tuple[int | None, str | None]], least_documents: int = 10, least_chars: int = 1) -> list[tuple[int, int, str]]:
    """(n_lines, n_dropped, kept) of each row, in plain Python: for tests."""

    def key(line: str) -> str:
        return line.strip(BLANKS).encode().lower().decode()

    where: dict[str, set] = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            where.setdefault(key(line), set()).add(("id", doc_id) if doc_id is not None else ("text", text or ""))
    out = []
    for _, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(key(x)) < least_chars or len(where[key(x)]) < least_documents]
        out.append((len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


#: The same with whole keys in place of hashes.
ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(CAST(doc_id AS VARCHAR), 'text ' || md5(coalesce(text, ''))) AS name, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, name, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
shared AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT name) >= 10),
kept AS (SELECT r, count(*) AS n, string_agg(line, chr(10) ORDER BY pos) AS text FROM k WHERE key NOT IN (SELECT key FROM shared) GROUP BY r)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - coalesce(n, 0) AS BIGINT) AS n_dropped, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
