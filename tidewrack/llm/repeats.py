"""Removal of long repeated byte strings, by prefix-free parsing.

A byte is removed if some LENGTH-byte string that covers it also starts elsewhere in the corpus, in the same
document or another. Documents are parsed into phrases at triggers: a string's trigger is the first place, of
its first REACH + 1, where a rolling hash of WINDOW bytes is least. It is seen in the string itself, so equal
strings are cut alike, whatever stands around them. The strings that start in one phrase, up to the trigger
that ends it, form a unit: all of them run through that trigger and into the same stretch of the parse.

In place of a sorted suffix array of the dictionary and one of the parse, whose order below depth LENGTH is
not needed here, suffixes are grouped into classes of equal ones, from coarse to fine:

1. by the stretch behind the trigger that every string of the unit holds: a unit whose stretch is unlike
   any other has no repeated string;
2. by the phrase and all that its strings run into: two units alike in that repeat as a whole;
3. where units share the stretch only, one unit for each distinct phrase and context is cut into pieces of
   PIECE strings, and these are grouped by the same two steps;
4. where pieces share the stretch only, one for each distinct context sends its strings' hashes, and equal
   ones are repeats.

Later steps see each distinct context once, so the many copies of a text cost one row for each phrase and not
for each byte. Two hashes of 64 bits each agree wherever equality decides. The keys that occur more than once are
written before they are joined, so that a join reads nothing but its two inputs and adaptive execution can split
a stretch that a third of all rows share.

Edge cases: a null or empty text, and one shorter than LENGTH, keeps all its bytes; a repeated row is another
document, so its copies remove each other; rows are told apart by their id and a hash of their text, and ids may be
null or repeat; a very long text is parsed whole, in memory that grows with that text alone; other columns, whatever
their names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.llm.common import WorkArea, in_slices, utf8

LENGTH, WINDOW, REACH, PIECE = 400, 32, 160, 8
GEAR = np.random.default_rng(8).integers(0, 1 << 32, 256, dtype=np.uint32)
#: Rows that a worker gathers before it sends them on.
ROWS = 100_000


def units(raw: np.ndarray, length: int = LENGTH, reach: int = REACH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, last start, trigger) of each unit of strings, in order."""
    last = len(raw) - length
    if last < 0:
        return (np.zeros(0, np.int64),) * 3
    h, span = GEAR[raw], 1
    while span < WINDOW:  # the sum of gear[byte i places back] << i, by doubling
        h[span:] += h[:-span] << np.uint32(span)
        span *= 2
    need = last + reach + 1
    wide = np.full(-(-need // (reach + 1)) * (reach + 1), np.iinfo(np.uint64).max, np.uint64)
    wide[:need] = (h[WINDOW - 1 : WINDOW - 1 + need].astype(np.uint64) << np.uint64(32)) | np.arange(need, dtype=np.uint64)
    # Least value of each run of reach + 1 places: the least to the block's end, and to the run's end from the next block's start.
    blocks = wide.reshape(-1, reach + 1)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(tail[: last + 1], head[reach : reach + last + 1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    lo = np.concatenate([[0], np.nonzero(np.diff(at))[0] + 1])
    return lo, np.append(lo[1:] - 1, last), at[lo]


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def unit_rows(docs: DataFrame, length: int, reach: int) -> DataFrame:
    """(stretch, context, doc, own, lo, hi, at) of every unit of (doc, own, data); doc and own tell rows apart."""
    names = ["stretch", "context", "doc", "own", "lo", "hi", "at"]
    digest = xxhash.xxh3_64_intdigest

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in names]

            def flush(out=out):
                made = pa.RecordBatch.from_arrays([_signed(out[0]), _signed(out[1]), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), *(pa.array(x, pa.int32()) for x in out[4:])], names)
                for x in out:
                    x.clear()
                return made

            for doc, own, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                b = data.as_py()
                lo, hi, at = units(np.frombuffer(b, np.uint8), length, reach)
                lo, hi, at = lo.tolist(), hi.tolist(), at.tolist()
                out[0] += [digest(b[t : t + length - reach]) for t in at]
                out[1] += [digest(b[i : j + length], 1) for i, j in zip(lo, hi, strict=True)]
                out[2] += [doc] * len(lo)
                out[3] += [own] * len(lo)
                out[4] += lo
                out[5] += hi
                out[6] += at
                if len(out[0]) >= ROWS:
                    yield flush()
            yield flush()

    return docs.transform(in_slices, run, "stretch long, context long, doc long, own long, lo int, hi int, at int")


def piece_rows(docs: DataFrame, length: int) -> DataFrame:
    """(stretch, context, doc, own, lo, strings): the units listed with each row (doc, own, data, units), cut into pieces of PIECE strings.

    Pieces lie at fixed distances from the trigger, so equal strings fall into like pieces."""
    names = ["stretch", "context", "doc", "own", "lo", "strings"]
    digest = xxhash.xxh3_64_intdigest

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in names]

            def flush(out=out):
                ends = np.concatenate([[0], np.cumsum([len(x) for x in out[5]])])
                strings = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _signed([h for x in out[5] for h in x]))
                made = pa.RecordBatch.from_arrays([_signed(out[0]), _signed(out[1]), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.int32()), strings], names)
                for x in out:
                    x.clear()
                return made

            for doc, own, data, listed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                b = data.as_py()
                for u in listed.as_py():
                    lo, hi, at = u["lo"], u["hi"], u["at"]
                    for k in range((at - hi) // PIECE, (at - lo) // PIECE + 1):
                        start, stop = at - PIECE * k - PIECE + 1, at - PIECE * k
                        first, last = max(lo, start), min(hi, stop)
                        out[0].append(digest(b[stop : start + length], 2 + k))
                        out[1].append(digest(b[first : last + length], 1))
                        out[2].append(doc)
                        out[3].append(own)
                        out[4].append(first)
                        out[5].append([digest(b[i : i + length]) for i in range(first, last + 1)])
                if len(out[0]) >= ROWS // PIECE:
                    yield flush()
            yield flush()

    return docs.transform(in_slices, run, "stretch long, context long, doc long, own long, lo int, strings array<long>")


def recurring(rows: DataFrame, keys: list[str], work: WorkArea, name: str) -> DataFrame:
    """The keys that more than one row has, written: counts are taken before the shuffle, so a frequent key is one row for each task."""
    return work.write(rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys), name)


def repeated(df: DataFrame, length: int = LENGTH, reach: int = REACH) -> tuple[DataFrame, DataFrame]:
    """Rows (doc, own, doc_id, data), and (doc, own, spans): the byte ranges, unmerged, that repeated strings cover."""
    if not WINDOW <= length - reach:
        raise ValueError("a stretch must hold a trigger's window")
    work = WorkArea(df.sparkSession, "repeats")
    own = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit("no id"), "text"))
    docs = df.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("doc"), own.alias("own"), F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("data"))
    rows = work.write(unit_rows(docs.where(F.octet_length("data") >= length).select("doc", "own", "data"), length, reach), "units")
    kept = work.write(rows.join(recurring(rows, ["stretch"], work, "stretches"), "stretch", "left_semi"), "shared")
    work.drop("units")
    # Each step looks at the classes of equal contexts, one row each, that share a stretch.
    classes = work.write(kept.groupBy("stretch", "context").agg(F.count("*").alias("n"), F.min(F.struct("doc", "own", "lo", "hi", "at")).alias("u")), "classes")
    whole = classes.where("n > 1").select("stretch", "context")
    span = lambda first, end: F.struct(first.alias("start"), end.cast("int").alias("end")).alias("span")
    spans = work.write(kept.join(whole, ["stretch", "context"], "left_semi").select("doc", "own", span(F.col("lo"), F.col("hi") + length)), "whole")
    work.drop("shared")
    mixed = classes.join(recurring(classes, ["stretch"], work, "mixed"), "stretch", "left_semi")
    picked = mixed.groupBy("u.doc", "u.own").agg(F.collect_list(F.struct("u.lo", "u.hi", "u.at")).alias("units"))
    pieces = work.write(piece_rows(docs.select("doc", "own", "data").join(picked, ["doc", "own"]), length), "pieces")
    work.drop("classes")
    kept = work.write(pieces.join(recurring(pieces, ["stretch"], work, "piece-stretches"), "stretch", "left_semi"), "shared-pieces")
    work.drop("pieces")
    alike = recurring(kept, ["stretch", "context"], work, "alike")
    in_pieces = work.write(kept.join(alike, ["stretch", "context"], "left_semi").select("doc", "own", span(F.col("lo"), F.col("lo") + F.size("strings") - 1 + length)), "in-pieces")
    one = work.write(kept.groupBy("stretch", "context").agg(F.min(F.struct("doc", "own", "lo", "strings")).alias("p")), "one")
    work.drop("shared-pieces")
    single = one.join(recurring(one, ["stretch"], work, "mixed-pieces"), "stretch", "left_semi")
    single = single.select("stretch", F.col("p.doc").alias("doc"), F.col("p.own").alias("own"), F.col("p.lo").alias("lo"), F.posexplode("p.strings").alias("place", "h"))
    twice = recurring(single, ["stretch", "h"], work, "twice")
    in_single = single.join(twice, ["stretch", "h"], "left_semi").select("doc", "own", span(F.col("lo") + F.col("place"), F.col("lo") + F.col("place") + length))
    found = work.write(spans.union(in_pieces).union(in_single).groupBy("doc", "own").agg(F.collect_list("span").alias("spans")), "spans")
    for name in ("stretches", "whole", "mixed", "piece-stretches", "alike", "in-pieces", "one", "mixed-pieces", "twice"):
        work.drop(name)
    return docs, found


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def deduplicate(df: DataFrame, length: int = LENGTH, reach: int = REACH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for every row of (doc_id, text); kept: the remaining bytes."""
    docs, found = repeated(df, length, reach)

    def run(batches):
        for batch in batches:
            sizes, removed, runs, kept = [], [], [], []
            for data, listed in zip(batch.column(1), batch.column(2), strict=True):
                b = data.as_py()
                spans = merge([(s["start"], s["end"]) for s in listed.as_py() or []])
                edges = [0, *(x for s in spans for x in s), len(b)]
                kept.append(b"".join(b[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True)))
                sizes.append(len(b))
                removed.append(len(b) - len(kept[-1]))
                runs.append(len(spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return docs.join(found, ["doc", "own"], "left").select("doc_id", "data", "spans").transform(in_slices, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def brute_force(texts: list[bytes], length: int = LENGTH) -> list[tuple[int, int, str]]:
    """(n_removed, n_spans, kept_sha256) of each text, by counting every string: for tests."""
    seen: dict[int, int] = {}
    digest = xxhash.xxh3_128_intdigest
    for t in texts:
        for i in range(len(t) - length + 1):
            h = digest(t[i : i + length])
            seen[h] = seen.get(h, 0) + 1
    out = []
    for t in texts:
        spans = merge([(i, i + length) for i in range(len(t) - length + 1) if seen[digest(t[i : i + length])] > 1])
        edges = [0, *(x for s in spans for x in s), len(t)]
        kept = b"".join(t[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True))
        out.append((len(t) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    return out


#: The same by counting every string of LENGTH bytes, told apart by MD5.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT r, i, md5(b[i + 1 : i + {LENGTH}]) AS h FROM (SELECT r, b, unnest(range(octet_length(b) - {LENGTH} + 1)) AS i FROM d WHERE octet_length(b) >= {LENGTH})),
hit AS (SELECT r, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
fresh AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= {LENGTH} THEN 0 ELSE 1 END AS first FROM hit),
spans AS (SELECT r, n, min(i) AS a, max(i) + {LENGTH} AS z FROM (SELECT *, sum(first) OVER (PARTITION BY r ORDER BY i) AS n FROM fresh) GROUP BY r, n),
runs AS (SELECT r, CAST(sum(z - a) AS BIGINT) AS removed, count(*) AS spans, list(a ORDER BY a) AS starts, list(z ORDER BY a) AS ends FROM spans GROUP BY r),
whole AS (SELECT doc_id, b, coalesce(removed, 0) AS removed, coalesce(spans, 0) AS spans, coalesce(starts, []) || [octet_length(b)] AS starts, [0] || coalesce(ends, []) AS ends FROM d LEFT JOIN runs USING (r))
SELECT doc_id, octet_length(b) AS n_bytes, removed AS n_removed, spans AS n_spans,
  sha256(list_reduce(list_transform(range(spans + 1), lambda j: CASE WHEN starts[j + 1] > ends[j + 1] THEN b[ends[j + 1] + 1 : starts[j + 1]] ELSE ''::BLOB END), lambda x, y: x || y)) AS kept_sha256, removed > 0 AS repeated
FROM whole
"""
