"""SimHash near-duplicates by the generalised pigeonhole principle.

Words are lower-cased (A-Z) runs of non-blank characters, shingles are k words joined by a space, and each
shingle's XXH64 votes on 64 bits. Two fingerprints link when they differ in at most `radius` bits. To find
links, correlated bits are grouped into m partitions; a dynamic program over estimated candidate counts gives
each partition its own threshold, the thresholds summing to radius - m + 1; a pair within the radius then
agrees within the threshold in some partition. Each fingerprint is indexed under its partition bits, probed
with every variant within the threshold, and each candidate is verified on all 64 bits.

Edge cases: a null or empty text has no words and fingerprint zero, linked like any other; a text shorter
than k words is one shingle; repeated rows share a fingerprint and so a component; components are made of
fingerprints, so unlike texts that share an id are not mixed; a component's id is the smallest of its rows, null where
none has one, and a row with a null id has a null component_id; ties between rows that could stay go to the smallest
id and then the smallest hash of the text; very long texts are read whole, CHUNK shingles at a time; other columns,
whatever their names, are passed on or not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.llm.common import FILE_ROWS, WorkArea, in_slices, utf8
from tidewrack.llm.components import connected_components

SEED, BITS, CHUNK = 42, 64, 1 << 16
LANES = 8
MIX = np.random.default_rng(6).integers(1, 1 << 63, LANES, dtype=np.uint64) | np.uint64(1)
#: Relative cost of shuffling one probe row and of verifying one candidate pair.
PROBE_COST, PAIR_COST = 1.0, 0.25
#: Larger buckets are linked through one-bit variants instead of by pairs (exact for a radius of 2 or less).
BUCKET = 128
#: The same for near copies, where larger buckets are compared with HEADS heads before the pairs that are left.
PAIRED, HEADS = 32, 3
#: How many common shingles are put last in the order of shingles, at most; one text in SAMPLED tells which they are, if OFTEN
#: or more of these have them. Results do not depend on any of this.
COMMON, SAMPLED, OFTEN = 1 << 17, 8, 4
#: Sets of fewer shingles are compared without a look at their fingerprints; deviations by which similar sets may differ in bits.
SKETCHED, DEVIATIONS = 64, 6


def fingerprint(data: bytes, k: int) -> int:
    """Unsigned fingerprint of a whole UTF-8 text."""
    words = data.lower().split()
    if not words:
        return 0
    if len(words) < k:
        shingles = iter([b" ".join(words)])
        total = 1
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False))
        total = len(words) - k + 1
    digest, votes, left = xxhash.xxh64_digest, np.zeros(BITS, np.int64), total
    while left > 0:
        n = min(CHUNK, left)
        raw = b"".join([digest(next(shingles), SEED) for _ in range(n)])
        votes += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(n, 8), axis=1).sum(axis=0, dtype=np.int64)
        left -= n
    return int.from_bytes(np.packbits(votes * 2 > total).tobytes(), "big")


def text_hash(text_col: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def fingerprints(df: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp): the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            fps = [(fingerprint(x.as_py(), k) ^ (1 << 63)) - (1 << 63) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], ["doc_id", "text_hash", "fp"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(text_col).alias("text_hash"), utf8(text_col).alias("data")).transform(in_slices, run, "doc_id long, text_hash long, fp long")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how often each two bits are both set: 64 x 64 sums over all fingerprints."""

    def run(batches):
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            raw = batch.column(0).to_numpy().astype(">i8")
            bits = np.unpackbits(raw.view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1].astype(np.float32)
            n, both = n + len(bits), both + bits.T @ bits
        cells = np.concatenate([[n], both.ravel()]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells), dtype=np.int32)), pa.array(cells)], ["cell", "n"])

    rows = fps.select("fp").transform(in_slices, run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    cells = np.zeros(BITS * BITS + 1)
    for r in rows:
        cells[r["cell"]] = r["n"]
    return int(cells[0]), cells[1:].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m groups of nearly equal width; each grows by the bit most correlated with it."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, groups = set(range(BITS)), []
    for g in range(m):
        width = len(free) // (m - g)
        group = [max(sorted(free), key=lambda b: corr[b, sorted(free)].sum())]
        free.discard(group[0])
        while len(group) < width:
            best = max(sorted(free), key=lambda b: corr[b, group].sum())
            group.append(best)
            free.discard(best)
        groups.append(sorted(group))
    return groups


def within(p: np.ndarray, bits: list[int]) -> np.ndarray:
    """P(two fingerprints differ in at most t of these bits), t = 0, 1, ..., from the bits' frequencies."""
    poly = np.ones(1)
    for b in bits:
        differ = 2 * p[b] * (1 - p[b])
        poly = np.convolve(poly, [1 - differ, differ])
    return np.minimum(np.cumsum(poly), 1)


def allocate(n: int, both: np.ndarray, radius: int, most: int = 6) -> list[tuple[list[int], int]]:
    """The cheapest (bits, threshold) plan; a threshold of -1 leaves its partition out."""
    p, plans = np.diag(both) / max(n, 1), []
    for m in range(1, min(most, radius + 1) + 1):
        groups, budget = group_bits(n, both, m), radius - m + 1
        best = {0: (0.0, [])}  # spent (each threshold plus one) -> cost, thresholds
        for bits in groups:
            close, step = within(p, bits), {}
            for spent, (cost, chosen) in best.items():
                for t in range(-1, budget + m - spent):
                    probes = sum(math.comb(len(bits), j) for j in range(t + 1))
                    extra = (PROBE_COST * n * (probes + 1) + PAIR_COST * n * n / 2 * close[min(t, len(bits))]) if t >= 0 else 0
                    if cost + extra < step.get(spent + t + 1, (math.inf,))[0]:
                        step[spent + t + 1] = (cost + extra, [*chosen, t])
            best = step
        cost, chosen = best[budget + m]
        plans.append((cost, list(zip(groups, chosen, strict=True))))
    return min(plans, key=lambda x: x[0])[1]


def _flips(bits: list[int], t: int) -> list[int]:
    masks = {0}
    for _ in range(t):
        masks |= {m ^ (1 << b) for m in masks for b in bits}
    return sorted((m ^ (1 << 63)) - (1 << 63) for m in masks if bin(m).count("1") <= t)


def _variant_keys(part: int, key, flips):
    return F.transform(flips, lambda x: F.struct(F.lit(part).alias("part"), key.bitwiseXOR(x).alias("key")))


def links(fps: DataFrame, radius: int, work: WorkArea) -> DataFrame:
    """(a, b) edges between distinct fingerprints, with the same components as all pairs within the radius (2 at most)."""
    if not 0 <= radius <= 2:
        raise ValueError("large buckets are linked exactly up to a radius of 2")
    n, both = bit_statistics(fps)
    keys, probes = [], []
    for i, (bits, t) in enumerate(allocate(n, both, radius)):
        if t < 0:
            continue
        mask = sum(1 << b for b in bits)
        key = F.col("fp").bitwiseAND(F.lit((mask ^ (1 << 63)) - (1 << 63)))
        keys.append(F.struct(F.lit(i).alias("part"), key.alias("key")))
        flips = F.array(*[F.lit(x).cast("long") for x in _flips(bits, t)])
        probes.append(_variant_keys(i, key, flips))
    index = fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.part", "k.key")
    probe = fps.select("fp", F.explode(F.concat(*probes)).alias("k")).select("fp", "k.part", "k.key")
    sizes = index.groupBy("part", "key").agg(F.count("*").alias("n"), F.min("fp").alias("only"))
    # A probe that meets only its own fingerprint ends here.
    met = work.write(probe.join(sizes, ["part", "key"]).where("n > 1 or only <> fp"), "met")
    small = met.where(F.col("n") <= BUCKET).select("part", "key", F.col("fp").alias("a"))
    held = index.join(sizes.where(F.col("n") <= BUCKET), ["part", "key"]).select("part", "key", F.col("fp").alias("b"))
    pairs = small.join(held, ["part", "key"]).where("a < b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).select("a", "b")
    hot = met.where(F.col("n") > BUCKET).select("fp").distinct()
    return pairs.union(_variant_links(hot, radius, work)).distinct()


def _variant_links(fps: DataFrame, radius: int, work: WorkArea) -> DataFrame:
    """Edges of the fingerprints of large buckets, one row for each variant and never a pair for each two members.

    Two fingerprints differ in at most 2 bits just when some value is within 1 bit of both, so linking each
    fingerprint to the least one that shares a variant keeps every component. With a radius of 1 a variant
    of one is compared with the other itself."""
    if radius == 0:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("false")
    flips = F.array(*[F.lit(x).cast("long") for x in _flips(list(range(BITS)), 1)])
    variants = fps.select("fp", F.explode(F.transform(flips, lambda x: F.col("fp").bitwiseXOR(x))).alias("v"))
    if radius == 1:
        return variants.join(fps.select(F.col("fp").alias("v")), "v", "left_semi").where("fp <> v").select(F.least("fp", "v").alias("a"), F.greatest("fp", "v").alias("b"))
    shared = variants.groupBy("v").agg(F.min("fp").alias("low"), F.count("*").alias("n")).where("n > 1").select("v", "low")
    return variants.join(shared, "v").where("fp <> low").select(F.col("low").alias("a"), F.col("fp").alias("b"))


def _row(id_col: str = "doc_id") -> Column:
    """What orders rows and tells them apart: a row with an id comes before one without."""
    return F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("doc_id"), F.col("text_hash"))


def _with_components(docs: DataFrame, groups: DataFrame, roots: DataFrame, key: str, work: WorkArea) -> DataFrame:
    """Rows (doc_id, text_hash, key) with component_id and `keep`, whether the row is its component's first.

    groups: (key, rep) of each key; roots: (node, root) of the keys that have links."""
    whole = groups.join(roots.withColumnRenamed("node", "of"), F.col(key) == F.col("of"), "left").select(key, "rep", F.coalesce("root", key).alias("root"))
    whole = work.write(whole, "roots", rows=groups.count())
    first = whole.groupBy("root").agg(F.min("rep").alias("first"))
    named = whole.join(first, "root").select(key, "first")
    found = docs.join(named, key)
    return found.select("doc_id", "text_hash", key, F.when(F.col("doc_id").isNotNull(), F.col("first.doc_id")).alias("component_id"), (_row() == F.col("first")).alias("keep"))


def near_duplicates(spark: SparkSession, df: DataFrame, k: int = 5, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp, component_id, keep) for every row: component_id is the smallest id reachable over links."""
    work = WorkArea(spark, "simhash")
    docs = work.write(fingerprints(df, k, id_col, text_col), "docs")
    groups = work.write(docs.groupBy("fp").agg(F.min(_row()).alias("rep")), "groups", rows=docs.count())
    edges = work.write(links(groups.select("fp"), radius, work), "links")
    roots = connected_components(edges, work)
    return _with_components(docs, groups, roots, "fp", work)


# --- wider fingerprints, for copies that differ in more than a few bits ---


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """LANES words of 64 bits: each shingle's hash is mixed with LANES odd constants, and each mix votes on 64 bits."""
    votes = np.zeros(LANES * 64, np.int64)
    for i in range(0, len(hashes), CHUNK // 8):
        mixed = hashes[i : i + CHUNK // 8, None] * MIX[None, :]
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        votes += np.unpackbits(mixed.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(votes * 2 > len(hashes)).view(np.int64)


def sketch_radius(jaccard: float) -> int:
    """Bits in which the wide fingerprints of two sets of this similarity differ, DEVIATIONS above the mean.

    A bit differs with the angle between the sets over pi, and the angle is widest where both are of one size."""
    p = math.acos(2 * jaccard / (1 + jaccard)) / math.pi
    n = LANES * 64
    return math.ceil(n * p + DEVIATIONS * math.sqrt(n * p * (1 - p)))


# --- copies by the similarity of their shingles ---


def shingle_set(data: bytes, k: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a whole text."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    digest = xxhash.xxh64_intdigest
    hashed = np.fromiter((digest(w, SEED) for w in words), np.uint64, len(words))
    total = len(words) - k + 1
    h = np.zeros(total, np.uint64)
    for i in range(k):
        h = (h ^ hashed[i : i + total]) * MIX[0]
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(h ^ (h >> np.uint64(32)))


def _node(hashes: np.ndarray) -> int:
    return (xxhash.xxh64_intdigest(hashes.tobytes(), SEED) ^ (1 << 63)) - (1 << 63)


def _least(n: float, share: float) -> int:
    """The least whole number that is not under share * n."""
    return math.ceil(share * n - 1e-9)


def _nodes(df: DataFrame, k: int) -> DataFrame:
    """(doc_id, text_hash, node, fp) of every row: equal nodes have equal sets of shingles; fp is the fingerprint."""

    def run(batches):
        for batch in batches:
            texts = [x.as_py() for x in batch.column(2)]
            fps = [(fingerprint(x, k) ^ (1 << 63)) - (1 << 63) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([_node(shingle_set(x, k)) for x in texts], pa.int64()), pa.array(fps, pa.int64())], ["doc_id", "text_hash", "node", "fp"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), utf8().alias("data")).transform(in_slices, run, "doc_id long, text_hash long, node long, fp long")


def fingerprint_pairs(nodes: DataFrame, radius: int, n: int) -> DataFrame:
    """(a, b), a < b: pairs of nodes of (node, fp), of which there are n at most, whose fingerprints differ in at most `radius`
    bits, with the same components as all of them: each fingerprint's least node stands for its others."""
    work = WorkArea(nodes.sparkSession, "fingerprints")
    nodes = work.write(nodes.select("node", "fp").distinct(), "nodes", rows=n)
    low = work.write(nodes.groupBy("fp").agg(F.min("node").alias("low")), "low", rows=n)
    found = work.write(links(low.select("fp"), radius, work), "links")
    end = lambda s: low.select(F.col("fp").alias(s), F.col("low").alias(f"low_{s}"))
    between = found.join(end("a"), "a").join(end("b"), "b").select(F.least("low_a", "low_b").alias("a"), F.greatest("low_a", "low_b").alias("b"))
    return nodes.join(low, "fp").select(F.col("low").alias("a"), F.col("node").alias("b")).union(between).where("a < b").distinct()


def _prefixes(df: DataFrame, k: int, jaccard: float, common: np.ndarray) -> DataFrame:
    """(key, node, place, size): of each set of `size` shingles the first ones in one order of all shingles, that of
    their hashes with the `common` ones last, as many that two sets of at least the Jaccard similarity share one."""
    shared = df.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        late = shared.value
        for batch in batches:
            keys, nodes, places, sizes = [], [], [], []
            for x in batch.column(0):
                hashes = shingle_set(x.as_py(), k)
                node, n = _node(hashes), len(hashes)
                if not n:
                    continue
                if len(late):
                    last = late[np.minimum(np.searchsorted(late, hashes), len(late) - 1)] == hashes
                    hashes = np.concatenate([hashes[~last], hashes[last]])
                first = n - _least(n, jaccard) + 1
                keys.append(hashes[:first].view(np.int64))
                nodes.append(np.full(first, node, np.int64))
                places.append(np.arange(first, dtype=np.int32))
                sizes.append(np.full(first, n, np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (keys, nodes, places, sizes)], ["key", "node", "place", "size"])

    # Rows of one key and node are the same: shuffled by both, a frequent key spreads over all tasks.
    return df.select(utf8().alias("data")).transform(in_slices, run, "key long, node long, place int, size int").dropDuplicates(["key", "node"])


def _common(df: DataFrame, k: int) -> np.ndarray:
    """Hashes, sorted, of the shingles that most texts of a sample have."""

    def run(batches):
        for batch in batches:
            found = [(h, n) for h in (shingle_set(x.as_py(), k) for x in batch.column(0)) if (n := _node(h)) % SAMPLED == 0 and len(h)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([h for h, _ in found]).view(np.int64)), pa.array(np.repeat([n for _, n in found], [len(h) for h, _ in found]))], ["key", "node"])

    rows = df.select(utf8().alias("data")).transform(in_slices, run, "key long, node long").dropDuplicates(["key", "node"])
    top = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "key").limit(COMMON)
    return np.sort(np.array([r["key"] for r in top.select("key").collect()], np.int64).view(np.uint64))


def _sets(df: DataFrame, k: int) -> DataFrame:
    """(node, f0..., hashes) of every row: its wide fingerprint and its set."""
    names = ["node", *FP, "hashes"]

    def run(batches):
        for batch in batches:
            found = [shingle_set(x.as_py(), k) for x in batch.column(0)]
            wide = np.stack([wide_fingerprint(h) for h in found]) if found else np.zeros((0, LANES), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([_node(h) for h in found], pa.int64()), *(pa.array(wide[:, i]) for i in range(LANES)), pa.array([h.tobytes() for h in found], pa.binary())], names)

    return df.select(utf8().alias("data")).transform(in_slices, run, ", ".join(f"{c} long" for c in names[:-1]) + ", hashes binary")


FP = [f"f{i}" for i in range(LANES)]


def _similar(pairs: DataFrame, sets: DataFrame, jaccard: float) -> DataFrame:
    """The pairs (a, b) whose whole sets have at least the Jaccard similarity.

    Fingerprints come first: a pair whose bits differ by more than DEVIATIONS deviations above what similar sets show is
    not read whole (odds of a wrong one: one in a billion), and neither are most pairs that are no copies."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = (np.frombuffer(s.as_py(), np.uint64) for s in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both >= _least(len(p) + len(q) - both, jaccard))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    size = F.octet_length("hashes") / 8
    fps = {s: sets.select(F.col("node").alias(s), size.alias(f"n{s}"), *[F.col(c).alias(f"{c}{s}") for c in FP]) for s in "ab"}
    apart = sum((F.bit_count(F.col(f"{c}a").bitwiseXOR(F.col(f"{c}b"))) for c in FP[1:]), F.bit_count(F.col("f0a").bitwiseXOR(F.col("f0b"))))
    close = pairs.join(fps["a"], "a").join(fps["b"], "b").where((F.least("na", "nb") < SKETCHED) | (apart <= sketch_radius(jaccard))).select("a", "b")
    a, b = (sets.select(F.col("node").alias(s), F.col("hashes").alias(f"h{s}")) for s in "ab")
    return close.join(a, "a").join(b, "b").select("a", "b", "ha", "hb").transform(in_slices, run, "a long, b long")


def near_copies(spark: SparkSession, df: DataFrame, k: int = 5, jaccard: float = 0.8, radius: int = 2) -> DataFrame:
    """(doc_id, text_hash, node, component_id, keep): documents whose sets of k-word shingles have at least the Jaccard similarity are linked.

    The first candidates are those of `links`: fingerprints that differ in `radius` bits at most, by partitions of correlated
    bits with thresholds of their own. Whole sets decide, and the fingerprints of many copies are further apart: a pair at
    0.8 whose edits stand together differs in about 77 of 512 bits, more than a pigeonhole plan can promise. So an exact
    way for the rest follows, and the result is exact at every size of the input, but for equal 64-bit hashes of unequal
    shingles or sets. Its candidates come from prefixes: with all shingles in one order, two sets that are similar enough share one of
    the first n - ceil(jaccard * n) + 1 of each. Bounds on size and place, and the distance of wide SimHash fingerprints,
    leave most candidates out, and whole sets decide the rest. Common shingles are put last in the order, which may be any:
    a text with many shingles of its own, which come before those that it shares with a large group, meets that group too
    late in its prefix to be a copy, and the bound on places leaves it out.

    Sets in a prefix bucket of PAIRED at most are compared with each other. In larger buckets they are first compared
    with a few heads, above all the one that has the fewest shingles of its own; then every two sets of one bucket that are
    not in one component yet and that the bounds allow are compared, linked ones included, so no component is missed. Edge cases are those of near_duplicates; texts without words are copies."""
    work = WorkArea(spark, "copies")
    docs = work.write(_nodes(df, k), "docs")
    n = docs.count()
    groups = work.write(docs.groupBy("node").agg(F.min(_row()).alias("rep")), "groups", rows=n)
    rows = work.write(_prefixes(df, k, jaccard, _common(df, k)), "prefixes")
    n_rows = rows.count()
    counts = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    # Counts are written first: a join of two plain tables is one that adaptive execution can split at a frequent key.
    met = work.write(rows.join(work.write(counts, "counts", rows=n_rows), "key"), "met", rows=n_rows)
    work.drop("prefixes")

    def side(rows: DataFrame, s: str, *more: str) -> DataFrame:
        return rows.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "place", "size", *more)])

    # The shared shingle is the first of each prefix that both have or a later one; the bound holds for the first.
    share = jaccard / (1 + jaccard)
    possible = (F.least("size_a", "size_b") >= jaccard * F.greatest("size_a", "size_b") - 1e-6) & (1 + F.least(F.col("size_a") - F.col("place_a") - 1, F.col("size_b") - F.col("place_b") - 1) >= share * (F.col("size_a") + F.col("size_b")) - 1e-6)

    def paired(joined: DataFrame) -> DataFrame:
        return joined.where(possible).select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()

    small, large = met.where(F.col("n") <= PAIRED), met.where(F.col("n") > PAIRED)
    # A pair costs more than a row, so files of pairs and of sets are smaller.
    pairs = fingerprint_pairs(docs, radius, n).union(paired(side(small, "a").join(side(small, "b"), "key").where("node_a < node_b"))).distinct()
    pairs = work.write(pairs, "pairs", rows=n + met.count(), per_file=FILE_ROWS // 10)
    n_pairs, n_large = pairs.count(), large.count()
    # One row of each set that is compared; a set's first row is told by its id and its text's hash.
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(large.select("node")).distinct()
    rep = wanted.join(groups, "node").select("rep.*").select(F.col("doc_id").alias("of"), "text_hash").distinct()
    texts = df.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), "text")
    texts = texts.join(rep, texts["doc_id"].eqNullSafe(rep["of"]) & (texts["text_hash"] == rep["text_hash"]), "left_semi")
    sets = work.write(_sets(texts, k).dropDuplicates(["node"]), "sets", rows=2 * n_pairs + n_large, per_file=FILE_ROWS // 50)
    linked = work.write(_similar(pairs, sets, jaccard), "linked", rows=n_pairs, per_file=FILE_ROWS // 50)
    roots = connected_components(linked, work, "cc")
    for turn in range(2):
        named = large.join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").withColumn("root", F.coalesce("root", "node")).drop("of")
        spread = work.write(named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key"), f"spread-{turn}", rows=n_large)
        if spread.isEmpty():
            break
        named = work.write(named.join(spread, "key"), f"large-{turn}", rows=n_large)
        if turn == 0:  # heads: the least members in some orders, the first by what stands before the shared shingle
            order = lambda i: F.struct(F.xxhash64("root", F.lit(i)) if i else F.col("place").cast("long"), F.col("node"))
            heads = named.groupBy("key").agg(*[F.min_by(F.struct("node", "place", "size", "root"), order(i)).alias(f"h{i}") for i in range(HEADS)])
            other = heads.select("key", F.explode(F.array_distinct(F.array(*[f"h{i}" for i in range(HEADS)]))).alias("h")).select("key", "h.*")
        else:
            other = named
        met_again = side(named, "a", "root").join(side(other, "b", "root"), "key").where("root_a <> root_b")
        more = work.write(paired(met_again if turn == 0 else met_again.where("node_a < node_b")), f"pairs-{turn}", rows=n_large * (HEADS if turn == 0 else PAIRED), per_file=FILE_ROWS // 2)
        linked = linked.union(work.write(_similar(more, sets, jaccard), f"linked-{turn}", rows=more.count(), per_file=FILE_ROWS // 50))
        roots = connected_components(linked, work, f"cc-{turn}")
    out = _with_components(docs, groups, roots, "node", work)
    for name in ("counts", "met", "pairs", "sets", "linked", *(f"{x}-{turn}" for turn in range(2) for x in ("spread", "large", "pairs", "linked"))):
        work.drop(name)
    return out


def keep_one(spark: SparkSession, df: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of `df`, all columns, that found (doc_id, text_hash, keep) keeps: of each component the one with the smallest
    id, or the smallest hash of its text among rows that share that id or have none; of rows alike in both, one."""
    work, tag = WorkArea(spark, "keep-one"), uuid.uuid4().hex[:8]
    found = work.write(found.select(F.col("doc_id").alias(f"id_{tag}"), F.col("text_hash").alias(f"hash_{tag}"), "keep"), "found")
    n = found.count()
    key = [f"id_{tag}", f"hash_{tag}"]
    # Which rows go, or repeat, grows with the documents, so they are never broadcast.
    gone = found.where("not keep").select(*key).distinct().hint("merge")
    alike = work.write(found.where("keep").groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key), "alike", rows=n)
    rows = df.withColumns({f"own_id_{tag}": F.col("doc_id").cast("long"), f"own_hash_{tag}": text_hash()})
    same = lambda other: rows[f"own_id_{tag}"].eqNullSafe(other[key[0]]) & (rows[f"own_hash_{tag}"] == other[key[1]])
    kept = rows.join(gone, same(gone), "left_anti")
    if alike.isEmpty():
        return kept.select(df.columns)
    once = rows.join(alike, same(alike), "left_semi").dropDuplicates([f"own_id_{tag}", f"own_hash_{tag}"])
    return kept.join(alike, same(alike), "left_anti").unionByName(once).select(df.columns)


def hex_fingerprint(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
