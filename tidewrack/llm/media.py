"""Media columns in a store of content-defined chunks.

A text's UTF-8 bytes, with zero bytes up to a positive multiple of 64, are the 8-bit samples of a mono WAV
file. The file is cut where a rolling gear hash of the last 32 bytes has its top CUT_BITS bits clear, no
closer than SMALLEST and no further apart than LARGEST bytes, so equal passages give equal chunks wherever
they stand. Chunk digests are deduplicated, and those a store already holds are left out by an anti-join;
new chunks are written once each, compressed with a dictionary that is fitted to a bounded sample. Files are
rebuilt from their ordered chunk lists by a join on the digest, and each rebuilt file must have the SHA-256
that it had when it was cut. Features come from the samples of the rebuilt file.

The store is bucketed by digest, so rebuilding moves a file's chunks only where it has several.

Edge cases: a null or empty text is 64 zero samples; equal texts share all chunks and are rebuilt once; ids
may be null or repeat; texts of any length are chunked whole; other columns, whatever their names, are not read; an empty
table gives no rows and an empty store.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import wave
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.llm.common import WorkArea, in_slices, shared_root, shuffle_cleanup, utf8

RATE, UNIT = 8000, 64
SMALLEST, LARGEST, CUT_BITS, WINDOW = 2048, 65536, 13, 32
GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint32)
#: The dictionary's size, the ids whose chunks it is fitted to, their bytes at most, and those of one id.
DICTIONARY, SAMPLE_ROWS, SAMPLE_BYTES, ROW_BYTES, LEVEL = 112_640, 2000, 8_000_000, 16_384, 15
#: The store is written for one part of the digests after another, so that no more than a part is shuffled at once.
PARTS = 2
#: Digests that a task remembers, to send each chunk once.
REMEMBERED = 200_000


def encode(data: bytes) -> bytes:
    """The WAV file of a text's bytes."""
    payload = data + bytes(-len(data) % UNIT if data else UNIT)
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(RATE)
        f.writeframes(payload)
    return out.getvalue()


def decode(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as f:
        return f.readframes(f.getnframes())


def feature(samples: bytes) -> str:
    """Mean, root mean square about the middle, zero crossings a sample and peak of 8-bit samples."""
    x = np.frombuffer(samples, np.uint8).astype(np.int32) - 128
    crossings = int(((x[1:] >= 0) != (x[:-1] >= 0)).sum())
    return f"mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};zcr={crossings / len(x):.4f};peak={int(np.abs(x).max())}"


def cut(media: bytes) -> list[int]:
    """Ends of the chunks."""
    n = len(media)
    if n <= SMALLEST:
        return [n]
    h = GEAR[np.frombuffer(media, np.uint8)]
    span = 1
    while span < WINDOW:  # the sum of gear[byte i places back] << i, by doubling
        h[span:] += h[:-span] << np.uint32(span)
        span *= 2
    marks = (np.nonzero(h < np.uint32(1 << (32 - CUT_BITS)))[0] + 1).tolist()
    ends, start = [], 0
    for m in marks:
        while m - start > LARGEST:
            start += LARGEST
            ends.append(start)
        if m - start >= SMALLEST and m < n:
            ends.append(m)
            start = m
    while n - start > LARGEST:
        start += LARGEST
        ends.append(start)
    return [*ends, n]


def _chunks(media: bytes):
    start = 0
    for end in cut(media):
        yield media[start:end]
        start = end


def manifests(df: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media, digests): the file's SHA-256 and its chunks' digests in order."""

    def run(batches):
        for batch in batches:
            sizes, whole, lists = [], [], []
            for x in batch.column(1):
                data = x.as_py()
                media = encode(data)
                sizes.append(len(data))
                whole.append(hashlib.sha256(media).digest())
                lists.append([hashlib.sha256(c).digest() for c in _chunks(media)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(whole, pa.binary()), pa.array(lists, pa.list_(pa.binary()))], ["doc_id", "n_bytes", "media", "digests"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("data")).transform(in_slices, run, "doc_id long, n_bytes long, media binary, digests array<binary>")


def fit_dictionary(df: DataFrame) -> bytes:
    """A compression dictionary for chunks; empty where the sample is too small for one.

    Ids are sampled before any text is read: the first SAMPLE_ROWS in the order of a hash, and of each at most ROW_BYTES. What
    is stored does not depend on it, only how small it gets."""
    ids = df.select(F.xxhash64("doc_id").alias("o"), F.col("doc_id").alias("of")).where("of is not null").distinct().orderBy("o", "of").limit(SAMPLE_ROWS)
    # SAMPLE_ROWS ids at most, so the broadcast has a bound.
    met = df.select("doc_id", F.substring(utf8(), 1, ROW_BYTES).alias("data")).join(F.broadcast(ids), F.col("doc_id") == F.col("of"))
    samples, held = [], 0
    for r in met.groupBy("o", "of").agg(F.min("data").alias("data")).orderBy("o", "of").collect():
        held += len(r["data"])
        if held > SAMPLE_BYTES:
            break
        samples += list(_chunks(bytes(r["data"])))
    try:
        return zstandard.train_dictionary(DICTIONARY, [s for s in samples if s]).as_bytes()
    except zstandard.ZstdError:
        return b""


def _dictionary(raw: bytes):
    return zstandard.ZstdCompressionDict(raw) if raw else None


def chunk_rows(df: DataFrame, dictionary: bytes, part: int = 0, parts: int = 1) -> DataFrame:
    """(digest, data): compressed chunks, those of one part of the digests; a task sends each that it remembers once."""

    def run(batches):
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary))
        seen: set[bytes] = set()
        for batch in batches:
            digests, data, held = [], [], 0
            for x in batch.column(0):
                for c in _chunks(encode(x.as_py())):
                    d = hashlib.sha256(c).digest()
                    if d[0] % parts != part or d in seen:
                        continue
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(d)
                    digests.append(d)
                    data.append(press.compress(c))
                    held += len(data[-1])
                if held > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(data, pa.binary())], ["digest", "data"])
                    digests, data, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(data, pa.binary())], ["digest", "data"])

    return df.select(utf8().alias("bytes")).transform(in_slices, run, "digest binary, data binary")


def store(df: DataFrame, dictionary: bytes, known: DataFrame | None = None, name: str | None = None) -> DataFrame:
    """Writes the chunks of (doc_id, text) that are not in `known` (digest, data) to a table below the shared folder, bucketed by digest."""
    spark = df.sparkSession
    name, n = name or f"tidewrack_chunks_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    for part in range(PARTS):
        new = chunk_rows(df, dictionary, part, PARTS).groupBy("digest").agg(F.first("data").alias("data"))
        if known is not None:
            new = new.join(known.select("digest"), "digest", "left_anti")
        with shuffle_cleanup(spark):
            # The chunks are compressed already.
            new.write.format("parquet").option("compression", "uncompressed").option("path", f"{shared_root(spark)}/{name}").bucketBy(n, "digest").sortBy("digest").mode("append").saveAsTable(name)
    return spark.table(name)


def drop_store(spark: SparkSession, name: str) -> None:
    """Forgets a store's table and deletes its files."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/{name}")
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def rebuild(files: DataFrame, chunks: DataFrame, dictionary: bytes) -> DataFrame:
    """(media, digests) distinct, and (digest, data) -> (media, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature).

    Raises if a rebuilt file does not have the digest that names it, or a chunk is missing."""
    parts = files.select("media", F.size("digests").alias("n"), F.posexplode("digests").alias("pos", "digest"))
    met = parts.join(chunks, "digest", "left").select("media", "n", F.struct("pos", "data").alias("part"))
    single = met.where("n = 1").select("media", F.array("part").alias("parts"))
    several = met.where("n > 1").groupBy("media").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    schema = "media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches):
        press = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
        for batch in batches:
            rows = []
            for media, parts in zip(batch.column(0), batch.column(1), strict=True):
                stored = b"".join([press.decompress(p["data"]) for p in parts.as_py()])
                if hashlib.sha256(stored).digest() != media.as_py():
                    raise ValueError("a rebuilt file differs from the one that was stored")
                payload = decode(stored)
                rows.append((media.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(payload)))
            kinds = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["media", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return single.union(several).transform(in_slices, run, schema)


def digest_columns(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Stores every text of (doc_id, text), reads it back, and returns one row for each.

    The store of this call goes when all has been read back, or when that fails."""
    work, name = WorkArea(spark, "media"), f"tidewrack_chunks_{uuid.uuid4().hex}"
    dictionary = fit_dictionary(df)
    listed = work.write(manifests(df), "manifests")
    try:
        chunks = store(df, dictionary, name=name)
        files = listed.groupBy("media").agg(F.first("digests").alias("digests"))
        read = work.write(rebuild(files, chunks, dictionary), "read")
    finally:
        drop_store(spark, name)
    return listed.drop("digests").join(read, "media").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def _little(value: str) -> str:
    """SQL of a number as four bytes in hexadecimal, the least first."""
    digits = f"printf('%08x', {value})"
    return " || ".join(f"substr({digits}, {i}, 2)" for i in (7, 5, 3, 1))


#: The same with the file built in place: header, padded bytes, CRC-32 bit by bit, features by sample.
ORACLE = f"""
WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a % 2 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END)) AS crc),
d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
p AS (SELECT r, doc_id, octet_length(b) AS n, b || repeat('\\x00'::BLOB, CASE WHEN octet_length(b) = 0 THEN {UNIT} ELSE ({UNIT} - octet_length(b) % {UNIT}) % {UNIT} END) AS payload FROM d),
m AS (SELECT *, octet_length(payload) AS size, unhex('52494646' || {_little('octet_length(payload) + 36')} || '57415645666d7420' || '10000000' || '01000100' || {_little(str(RATE))} || {_little(str(RATE))} || '01000800' || '64617461' || {_little('octet_length(payload)')}) || payload AS media FROM p),
x AS (SELECT r, i, CAST('0x' || hex(payload[i + 1 : i + 1]) AS INT) - 128 AS v FROM (SELECT r, payload, unnest(range(size)) AS i FROM m)),
y AS (SELECT r, v, (v >= 0) <> lag(v >= 0) OVER (PARTITION BY r ORDER BY i) AS crossing FROM x),
f AS (SELECT r, format('mean={{:.4f}};rms={{:.4f}};zcr={{:.4f}};peak={{}}', sum(v) / CAST(count(*) AS DOUBLE), sqrt(sum(v * v) / CAST(count(*) AS DOUBLE)), count(*) FILTER (crossing) / CAST(count(*) AS DOUBLE), max(abs(v))) AS feature FROM y GROUP BY r)
SELECT doc_id, n AS n_bytes, size AS payload_bytes, sha256(payload) AS payload_sha256,
  xor(4294967295, list_reduce([4294967295] || list_transform(range({UNIT}), lambda j: CAST('0x' || hex(payload[size - {UNIT} + j + 1 : size - {UNIT} + j + 1]) AS BIGINT)), lambda a, c: xor(crc[(xor(a, c) & 255) + 1], a >> 8))) AS tail_crc32,
  octet_length(media) AS media_bytes, sha256(media) AS media_sha256, feature
FROM m JOIN f USING (r), t
"""
