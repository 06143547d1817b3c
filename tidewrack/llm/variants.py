"""Groups of spelling variants, by full neighbourhoods.

Every word emits all distinct strings that one deletion, replacement or insertion of a letter of the observed alphabet
makes of it, and a hash join of these with the vocabulary gives exactly the words one edit away; no distance is computed.
A word of ten letters has about a thousand such strings, nearly none of them a word. So neighbourhoods are hashed before any string is built: the hash is a
polynomial of the code points, and an edit's hash follows from those of what stands before and behind it. A bit table of
the vocabulary's hashes, of a fixed size, leaves out what can't be a word; the others become strings and are joined.
The table only spares rows: a string that it lets pass wrongly finds no partner in the join.

A word's form is its near word of largest count, if that is at least `ratio` times its own; roots follow forms to
the last by pointer doubling, each round a join of written tables. Counts rise along a chain by `ratio`, so chains are as short as the
logarithm of the largest count, and have no loops.

Edge cases: a null or empty text has no words; a null id is hashed as an empty one; repeated rows and ids count each time; a
very long text is one row, and its words are exploded; a frequent word is summed in each task first; ties of count go to the
smallest word in code-point order; other columns, whatever their names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.llm.common import WorkArea, ascii_lower, in_slices

RUN = "[a-zÀ-ÿ]+"
#: Bits of the table: 8 MB, whatever the vocabulary's size. Parts of the table that are put together one by one.
TABLE_BITS, PART_BITS = 26, 16
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Hashes of neighbours that a worker holds at a time.
HELD = 2_000_000


def words(df: DataFrame, misprint_every: int | None = None) -> DataFrame:
    """(word, n): the runs of letters of (doc_id, text), A-Z in lower case, and how often each occurs.

    misprint_every: a run loses one letter where that number divides the CRC-32 of "<doc_id>:<run>", which plants known misprints."""
    runs = df.select("doc_id", F.explode(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(RUN), 0)).alias("word"))
    word = F.col("word")
    if misprint_every:
        h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
        runs = runs.withColumn("h", h)
        at = (F.col("h") % F.char_length("word")).cast("int")
        word = F.when(F.col("h") % misprint_every == 0, F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.char_length("word")))).otherwise(F.col("word"))
    return runs.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _places(h: np.ndarray) -> Iterator[np.ndarray]:
    """Where a hash sets its bits in the table, one after another."""
    once, mask = _mix(h), np.uint64((1 << TABLE_BITS) - 1)
    yield once & mask
    yield (once >> np.uint64(32)) & mask
    yield _mix(once + BASE) & mask


def _held(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Indexes of the hashes whose bits are all set."""
    left = np.arange(len(h))
    for k in range(3):
        at = next(p for i, p in enumerate(_places(h[left])) if i == k)
        left = left[(table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
    return left


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, BASE)]), dtype=np.uint64)


def _codes(same_length: list[str]) -> np.ndarray:
    return np.array([[ord(c) for c in w] for w in same_length], np.uint64).reshape(len(same_length), -1)


def hashes(same_length: list[str]) -> np.ndarray:
    """The sum of code point times BASE ** places behind it, modulo 2 ** 64."""
    codes = _codes(same_length)
    return (codes * _powers(codes.shape[1])[:-1][::-1]).sum(axis=1, dtype=np.uint64)


def by_length(some: list[str]) -> dict[int, list[str]]:
    out: dict[int, list[str]] = {}
    for w in some:
        out.setdefault(len(w), []).append(w)
    return out


def near_strings(same_length: list[str], alphabet: str, table: np.ndarray) -> Iterator[tuple[str, str]]:
    """(word, string) for all distinct strings one edit from a word that the table lets pass.

    A string made in several ways is emitted once: a letter is deleted at the start of its run only, and inserted only
    where none like it stands before."""
    codes, letters = _codes(same_length), np.array([ord(c) for c in alphabet], np.uint64)
    m, n = codes.shape
    power = _powers(n + 1)
    before = np.zeros((m, n + 1), np.uint64)  # the hash of the letters before each place
    for i in range(n):
        before[:, i + 1] = before[:, i] * BASE + codes[:, i]
    behind = np.zeros((m, n + 1), np.uint64)  # the share of the letters from each place on
    for i in reversed(range(n)):
        behind[:, i] = behind[:, i + 1] + codes[:, i] * power[n - 1 - i]
    follows = np.concatenate([np.zeros((m, 1), np.uint64), codes], axis=1)  # the letter before each place
    for i in range(n + 1):
        rest = n - 1 - i
        if i < n:
            gone = np.nonzero(follows[:, i] != codes[:, i])[0]
            for j in gone[_held(before[gone, i] * power[rest] + behind[gone, i + 1], table)]:
                w = same_length[j]
                yield w, w[:i] + w[i + 1 :]
            row, letter = np.nonzero(codes[:, i, None] != letters[None, :])
            for j in _held(before[row, i] * power[rest + 1] + letters[letter] * power[rest] + behind[row, i + 1], table):
                w = same_length[row[j]]
                yield w, w[:i] + alphabet[letter[j]] + w[i + 1 :]
        row, letter = np.nonzero(follows[:, i, None] != letters[None, :])
        for j in _held(before[row, i] * power[rest + 2] + letters[letter] * power[rest + 1] + behind[row, i], table):
            w = same_length[row[j]]
            yield w, w[:i] + alphabet[letter[j]] + w[i:]


def bit_table(vocabulary: DataFrame) -> bytes:
    """The table of the hashes of (word, ...): 2 ** TABLE_BITS bits, put together in parts of 2 ** PART_BITS."""

    def places(batches):
        for batch in batches:
            for same in by_length(batch.column(0).to_pylist()).values():
                at = np.concatenate(list(_places(hashes(same)))).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at >> PART_BITS), pa.array((at & ((1 << PART_BITS) - 1)).astype(np.int32))], ["part", "bit"])

    def pack(group: pa.Table) -> pa.Table:
        bits = np.zeros(1 << PART_BITS, np.uint8)
        bits[group.column("bit").to_numpy()] = 1
        return pa.table({"part": group.column("part")[:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    # Distinct bits: a part has 2 ** PART_BITS rows at most, and the driver gets 2 ** TABLE_BITS bits at most.
    parts = vocabulary.select("word").transform(in_slices, places, "part long, bit int").distinct().groupBy("part").applyInArrow(pack, "part long, bits binary")
    size = 1 << (PART_BITS - 3)
    table = bytearray(1 << (TABLE_BITS - 3))
    for r in parts.toLocalIterator():
        table[r["part"] * size : (r["part"] + 1) * size] = r["bits"]
    return bytes(table)


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """(word, near, near_n): all pairs of words one edit apart, both ways, of a written table (word, n)."""
    spark = vocabulary.sparkSession
    letters = vocabulary.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct()
    alphabet = "".join(sorted(r["c"] for r in letters.collect()))  # as many rows as the alphabet of RUN has letters, at most
    table = spark.sparkContext.broadcast(bit_table(vocabulary))

    def run(batches):
        bits = np.frombuffer(table.value, np.uint8)
        for batch in batches:
            pairs = []
            for n, same in by_length(batch.column(0).to_pylist()).items():
                step = max(1, HELD // max(1, (n + 1) * len(alphabet)))
                for i in range(0, len(same), step):
                    pairs += near_strings(same[i : i + step], alphabet, bits)
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)], ["word", "near"])

    made = vocabulary.select("word").transform(in_slices, run, "word string, near string")
    return made.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "near", "near_n")


def last_of(spark: SparkSession, steps: DataFrame, work: WorkArea) -> DataFrame:
    """(word, root) of (word, form) without loops: forms followed to the last, twice as far each round."""
    now, k = work.write(steps.select("word", F.col("form").alias("root")), "roots0"), 0
    while True:
        k += 1
        further = now.select(F.col("word").alias("of"), F.col("root").alias("beyond"))
        moved = now.join(further, F.col("root") == F.col("of"), "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved"))
        moved = work.write(moved, f"roots{k}")
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        now = moved.select("word", "root")


def group(df: DataFrame, least_length: int = 6, least_count: int = 5, ratio: int = 5, misprint_every: int | None = None) -> DataFrame:
    """Gives (word, form, root, n, n_near, form_n) for each word of (doc_id, text) of that length and count."""
    if ratio <= 1:
        raise ValueError("the ratio must be above 1: words of one count would be each other's forms")
    spark = df.sparkSession
    work = WorkArea(spark, "variants")
    counted = words(df, misprint_every).where((F.char_length("word") >= least_length) & (F.col("n") >= least_count))
    vocabulary = work.write(counted, "vocabulary")
    near = neighbours(vocabulary).groupBy(F.col("word").alias("of")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    takes = -F.col("best.less") >= ratio * F.col("n")
    met = vocabulary.join(near, F.col("word") == F.col("of"), "left")
    met = met.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(takes, F.col("best.near")).alias("form"), F.when(takes, -F.col("best.less")).alias("form_n"))
    formed = work.write(met, "formed")
    roots = last_of(spark, formed.where("form is not null").select("word", "form"), work).withColumnRenamed("word", "of")
    return formed.join(roots, F.col("word") == F.col("of"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: Another way to the same pairs: words that differ by a replacement share what is left without the letter at one place; by
#: an insertion, one is the other without a letter. CRC-32 bit by bit.
ORACLE = r"""
WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a % 2 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END)) AS crc),
r AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS word FROM documents) GROUP BY 1, 2),
b AS (SELECT *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || word)) AS x FROM r),
h AS (SELECT word, n, xor(4294967295, list_reduce([4294967295] || list_transform(range(len(x) // 2), lambda j: CAST('0x' || substr(x, 2 * j + 1, 2) AS BIGINT)), lambda a, c: xor(crc[(xor(a, c) & 255) + 1], a >> 8))) AS h FROM b, t),
w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(word, 1, h % length(word)) || substr(word, h % length(word) + 2) ELSE word END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w GROUP BY 1 HAVING sum(n) >= 5 AND length(any_value(word)) >= 6),
d AS (SELECT DISTINCT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
e AS (SELECT DISTINCT d.word AS a, v.word AS b FROM d JOIN v ON v.word = d.rest),
p AS (SELECT x.word AS a, y.word AS b FROM d x JOIN d y USING (i, rest) WHERE x.word <> y.word UNION SELECT a, b FROM e UNION SELECT b, a FROM e),
q AS (SELECT p.a AS word, count(*) AS n_near, max(v.n) AS top, (array_agg(p.b ORDER BY v.n DESC, encode(p.b)))[1] AS best FROM p JOIN v ON v.word = p.b GROUP BY 1),
f AS (SELECT v.word, v.n, coalesce(q.n_near, 0) AS n_near, CASE WHEN q.top >= 5 * v.n THEN q.best END AS form, CASE WHEN q.top >= 5 * v.n THEN q.top END AS form_n FROM v LEFT JOIN q USING (word)),
g AS (SELECT * FROM (WITH RECURSIVE s AS (SELECT word, form AS root, 1 AS k FROM f WHERE form IS NOT NULL UNION ALL SELECT s.word, f.form, s.k + 1 FROM s JOIN f ON f.word = s.root WHERE f.form IS NOT NULL) SELECT word, arg_max(root, k) AS root FROM s GROUP BY 1))
SELECT f.word, f.form, coalesce(g.root, f.word) AS root, f.n, f.n_near, f.form_n FROM f LEFT JOIN g ON g.word = f.word
"""
