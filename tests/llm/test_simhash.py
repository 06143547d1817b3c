import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tidewrack.llm import simhash
from tidewrack.llm.common import WorkArea
from tidewrack.llm.components import connected_components


def frame(spark, rows, more=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + more)


def plain(text, k):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def brute(rows, k, radius):
    fps = [(i, plain(t, k)) for i, t in rows]
    pairs = [(a, b) for a, x in fps for b, y in fps if a < b and bin(x ^ y).count("1") <= radius]
    return roots(pairs, [i for i, _ in fps])


def test_fingerprint_matches_plain_version():
    for text in ("", " \t\n", "One", "one two", "a b c", "É é x " * 40, "word " * 200):
        assert simhash.fingerprint(text.encode(), 3) == plain(text, 3)


def test_components_against_brute_force(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows, n = [], 0
    for _ in range(25):
        base = [r.choice(words) for _ in range(r.randint(30, 120))]
        for _ in range(r.randint(1, 6)):
            copy = list(base)
            if r.random() < 0.5:
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append((n, " ".join(copy)))
            n += 1
    rows += [(n, ""), (n + 1, None), (n + 2, "x"), (n + 3, "x")]
    got = {x["doc_id"]: x["component_id"] for x in simhash.near_duplicates(spark, frame(spark, rows), k=3).collect()}
    assert got == brute(rows, 3, 2)


@pytest.mark.parametrize("bucket", [0, 2, 128])
def test_large_buckets_keep_every_component(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    r = random.Random(7)
    fps = set()
    for _ in range(12):
        x = r.getrandbits(64)
        for _ in range(12):
            fps.add(x)
            x ^= 1 << r.randrange(64)
            if r.random() < 0.6:
                x ^= 1 << r.randrange(64)
    signed = {(f ^ (1 << 63)) - (1 << 63): f for f in fps}
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    edges = [(x["a"], x["b"]) for x in simhash.links(df, 2, WorkArea(spark, "t")).collect()]
    want = roots([(a, b) for a in signed for b in signed if a < b and bin(signed[a] ^ signed[b]).count("1") <= 2], list(signed))
    assert roots(edges, list(signed)) == want


def test_allocation_is_a_pigeonhole_plan():
    import numpy as np

    both = np.full((64, 64), 250.0) + np.diag(np.full(64, 250.0))
    for n in (100, 10**6, 10**11):
        plan = simhash.allocate(n, both * n / 1000, 2)
        assert sorted(b for bits, _ in plan for b in bits) == list(range(64))
        assert sum(t for _, t in plan) == 2 - len(plan) + 1


def test_edge_rows(spark):
    rows = [(1, "a b c d", 0), (1, "a b c d", 0), (None, "a b c d", 1), (2, "other words here now", 2)]
    df = frame(spark, rows, ", fp int").withColumn("component_id", F.lit("clash"))
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(spark, df, k=3).collect()), key=str)
    assert got == [(1, 1), (1, 1), (2, 2), (None, None)]
    kept = simhash.keep_one(spark, df, simhash.near_duplicates(spark, df, k=3))
    copies = simhash.near_copies(spark, df)
    assert sorted(((r["doc_id"], r["component_id"]) for r in copies.collect()), key=str) == got and simhash.near_copies(spark, df.where("false")).count() == 0
    # A copy without an id goes, since a row with one stands for it.
    assert kept.columns == df.columns and sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 2]
    assert simhash.near_duplicates(spark, df.where("false"), k=3).count() == 0


@pytest.mark.parametrize("how", [simhash.near_copies, lambda s, d: simhash.near_duplicates(s, d, k=3)])
def test_rows_are_told_apart_by_more_than_their_id(spark, how):
    """Unlike texts under one id all stay; of copies without an id one does; of rows alike in all, one."""
    rows = [(1, "a b c d e f g h", "x"), (1, "quite other words stand here now and then", "y"), (1, "quite other words stand here now and then", "y")]
    rows += [(None, "nobody gave this text a number so far", "z")] * 3 + [(None, "nor this one which is not like it", "z"), (7, "a b c d e f g h", "v"), (8, None, "n"), (9, "", "n")]
    df = frame(spark, rows, ", keep string").withColumn("text_hash", F.lit(5)).withColumn("node", F.lit("n"))
    kept = simhash.keep_one(spark, df, how(spark, df))
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    want = [(1, "a b c d e f g h"), (1, "quite other words stand here now and then"), (8, None), (None, "nobody gave this text a number so far"), (None, "nor this one which is not like it")]
    assert got == sorted(want, key=str) and kept.columns == df.columns
    assert simhash.keep_one(spark, df.where("false"), how(spark, df.where("false"))).count() == 0


def test_similar_sets_have_close_fingerprints():
    """The distance under which pairs are read whole leaves room: 400 pairs at 0.8 stay far below it."""
    import numpy as np

    r, most = np.random.default_rng(5), 0
    for i in range(400):
        n = 64 + 8 * i
        both = round(0.8 * 2 * n / 1.8) + 1
        a, b, c = (r.integers(0, 1 << 63, k, dtype=np.uint64) for k in (both, n - both, n - both))
        p, q = simhash.wide_fingerprint(np.concatenate([a, b])), simhash.wide_fingerprint(np.concatenate([a, c]))
        most = max(most, sum(bin(int(x) & (1 << 64) - 1).count("1") for x in p ^ q))
    assert most < simhash.sketch_radius(0.8) - 10
    assert simhash.sketch_radius(0.8) < 140


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(edges, WorkArea(spark, "cc")).collect()}
    assert len(got) == 201 and {got[i] for i in range(1, 201)} == {0} and got[501] == 500


def test_near_copies_of_large_groups(spark, monkeypatch):
    r = random.Random(11)
    words = [f"w{i}" for i in range(2000)]

    def edited(base, n):
        out = list(base)
        for _ in range(n):
            out[r.randrange(len(out))] = r.choice(words)
        return " ".join(out)

    bases = [[r.choice(words) for _ in range(200)] for _ in range(4)]
    rows = [(i, edited(bases[0], r.randint(0, 4))) for i in range(150)]
    rows += [(200 + 10 * b + i, edited(bases[b], i)) for b in (1, 2, 3) for i in range(3)]
    rows += [(900 + i, " ".join(r.choice(words) for _ in range(150))) for i in range(40)]
    want = {i: 0 if i < 150 else 200 + (i - 200) // 10 * 10 if i < 900 else i for i, _ in rows}
    for bucket in (128, 8):
        monkeypatch.setattr(simhash, "PAIRED", bucket)
        got = {x["doc_id"]: x["component_id"] for x in simhash.near_copies(spark, frame(spark, rows)).collect()}
        assert got == want


def jaccard_roots(rows, k=5, least=0.8):
    def grams(text):
        words = text.encode().lower().split()
        return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}

    sets = {i: grams(t) for i, t in rows}
    near = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-9]
    return roots(near, list(sets))


def fresh(r, n):
    return [f"v{r.randrange(10**6)}" for _ in range(n)]


def same_as_jaccard(spark, texts):
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = {x["doc_id"]: x["component_id"] for x in simhash.near_copies(spark, frame(spark, rows)).collect()}
    want = jaccard_roots(rows)
    assert got == want, f"{sum(got[i] != want[i] for i in want)} of {len(want)} rows in another component"


def test_near_copies_under_any_edit_shape(spark):
    """Appended, cut and replaced passages on both sides of 0.8."""
    r, texts = random.Random(23), []
    for _ in range(20):
        base, n = fresh(r, 300), r.randint(50, 80)
        texts += [base]
        texts += [r.choice([base + fresh(r, n), base[: 300 - n], base[:100] + fresh(r, n // 2) + base[100 + n // 2 :]])]
    same_as_jaccard(spark, texts)


def test_near_copies_with_scattered_edits(spark):
    """Single words on both sides of 0.8; what is found does not depend on how many other texts there are."""
    r, texts = random.Random(29), []
    for _ in range(100):
        base = fresh(r, 300)
        copy = list(base)
        for i in r.sample(range(300), r.randint(5, 9)):
            copy[i] = fresh(r, 1)[0]
        texts += [base, copy]
    same_as_jaccard(spark, texts)


def test_near_copies_in_large_buckets(spark, monkeypatch):
    """Copies of copies, each near its parent only, and a passage that many other texts share."""
    monkeypatch.setattr(simhash, "PAIRED", 4)
    r = random.Random(31)
    chain, passage = [fresh(r, 200)], fresh(r, 60)
    for _ in range(150):
        parent = list(r.choice(chain))
        at = r.randrange(180)
        parent[at : at + 15] = fresh(r, 15)
        chain.append(parent)
    same_as_jaccard(spark, chain + [fresh(r, 40) + passage + fresh(r, 40) for _ in range(60)])


def test_near_copies_by_fingerprints_first(spark, monkeypatch):
    """Links of fingerprints are candidates by themselves, without any prefix; sets decide, so unlike texts are not linked."""
    r, prefixes = random.Random(37), simhash._prefixes
    base = [fresh(r, 3000) for _ in range(4)]
    texts = base + [[*b[:at], *fresh(r, 1), *b[at + 1 :]] for b in base for at in (5, 1500, 2990)] + [list(reversed(base[0])), [], ["one"]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    fps = {i: plain(t, 5) for i, t in rows}
    close = [(a, b) for a in fps for b in fps if a < b and bin(fps[a] ^ fps[b]).count("1") <= 2]
    nodes = simhash._nodes(frame(spark, rows), 5)
    own = {x["node"]: x["doc_id"] for x in nodes.collect()}
    found = [(own[x["a"]], own[x["b"]]) for x in simhash.fingerprint_pairs(nodes, 2, len(rows)).collect()]
    assert len(close) > 3 and roots(found, fps) == roots(close, fps)
    monkeypatch.setattr(simhash, "_prefixes", lambda *args: prefixes(*args).where("false"))
    got = {x["doc_id"]: x["component_id"] for x in simhash.near_copies(spark, frame(spark, rows)).collect()}
    assert got == {i: min(j for j in fps if roots(close, fps)[j] == roots(close, fps)[i]) for i in fps}
