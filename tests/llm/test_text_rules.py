"""Licenses, mixing and decontamination on small fixtures."""

import random

import pytest

from tidewrack.llm import decontaminate, licenses, mixing


def frame(spark, rows, columns="doc_id long, text string"):
    return spark.createDataFrame(rows, columns)


# --- licenses ---


def scan(spark, *texts):
    df = frame(spark, [(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, label string")
    return {r["doc_id"]: r for r in licenses.scan(df).collect()}


def test_license_places(spark):
    got = scan(spark, "Released Under the MIT License. again, under-the/MIT license", "CC BY-NC 4.0 cc by nc", "under the mitt license", "", None, "a b", "the apache license version 2", "éunder the mit license", "under the mit license" * 1)
    assert (got[0]["n_base"], got[0]["first_word"], got[0]["last_word"], got[0]["base_labels"], got[0]["n_words"]) == (2, 1, 6, "mit", 10)
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (2, 0, 5, "cc-by-nc")
    assert got[2]["n_base"] == 0 and got[2]["first_word"] is None and got[2]["base_labels"] == "" and got[2]["score"] < 1
    assert got[3]["n_words"] == got[4]["n_words"] == 0 and got[4]["labels"] == "" and got[5]["n_words"] == 2
    assert got[6]["base_labels"] == "apache-2" and got[7]["n_base"] == 0 and got[8]["n_base"] == 1


def test_broken_diagonals_are_merged(spark):
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    changed = notice.replace("any person", "any natural person").replace("this software", "the software")
    got = scan(spark, notice, changed, " ".join(notice.split()[:6]))
    assert got[0]["labels"] == "mit" and got[0]["score"] == 1 and got[1]["labels"] == "mit" and 0.6 <= got[1]["score"] < 1
    assert got[2]["labels"] == "" and 0 < got[2]["score"] < 0.6


def test_whole_texts_with_gaps(spark):
    """A whole license is told where words are left out or put in, and not from a few of its phrases."""
    r = random.Random(4)
    rows = []
    for i, (text, _) in enumerate(licenses.TEXTS):
        w = text.split()
        for at in sorted(r.sample(range(len(w)), max(1, len(w) // 60)), reverse=True):
            w[at : at + 1] = [] if r.random() < 0.5 else [w[at], "Inserted"]
        rows.append((i, f"{filler(i, 200)} {' '.join(w)} {filler(50 + i, 3000)}", 1))
    rows += [(100, filler(7, 20_000), 1), (101, "THE SOFTWARE IS PROVIDED as a gift, without warranty of any kind", 1)]
    got = {x["doc_id"]: x for x in licenses.scan(frame(spark, rows, "doc_id long, text string, score int")).collect()}
    for i, (_, label) in enumerate(licenses.TEXTS):
        assert label in got[i]["labels"].split(",") and got[i]["score"] >= 0.6
    assert got[100]["labels"] == got[101]["labels"] == "" and got[100]["n_words"] == 20_000


def test_license_rows_that_repeat(spark):
    df = frame(spark, [(1, "under the mit license"), (1, "under the mit license"), (1, "none"), (None, "cc by nc"), (None, None)])
    assert sorted((r["n_base"] for r in licenses.scan(df).collect())) == [0, 0, 1, 1, 1]
    assert licenses.scan(df.where("false")).count() == 0


# --- mixing ---


def fill(sizes, share=1.5, most=2.0, weights=(3, 1, 2)):
    """Targets by resharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    out, left, free = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while left > 1e-9 and free:
        unit = left / sum(w[s] for s in free)
        left = 0.0
        for s in list(free):
            out[s] += unit * w[s]
            if out[s] >= most * sizes[s]:
                left += out[s] - most * sizes[s]
                out[s] = most * sizes[s]
                free.discard(s)
    return out


def test_targets_by_resharing(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 20, None: 300}, {"a": 5}, {"a": 0, "b": 7}, {"b": 100, "a": 100, "c": 100, "d": 1}):
        df = frame(spark, [(s, n) for s, n in sizes.items()], "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
        assert got == pytest.approx(fill(sizes))


def test_mix(spark):
    r = random.Random(1)
    rows = [(i, " ".join(["w"] * r.randint(0, 30)), r.choice(["big", "big", "big", "b", None]), i) for i in range(600)]
    rows += [(600, None, "b", 0), (601, "", "empty", 0), (5, rows[5][1], rows[5][2], 5)]
    df = frame(spark, rows, "doc_id long, text string, source string, size int")
    labels = frame(spark, [(i, i % 2) for i in range(0, 300)], "doc_id long, quality int")
    got = mixing.mix(df.drop("size"), labels).collect()
    again = mixing.mix(df.drop("size").repartition(7), labels).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    by = {}
    for x in got:
        by.setdefault(x["source"], []).append(x)
        assert x["taken"] <= 2 * x["size"] and x["taken"] >= x["copies"] * x["size"]
    for own in by.values():
        total = sum(x["size"] for x in own)
        assert own[0]["source_size"] == total and abs(sum(x["taken"] for x in own) - own[0]["target"]) <= 30
    assert mixing.mix(df.drop("size").where("false")).count() == 0


def test_good_documents_are_taken_more_often(spark):
    df = frame(spark, [(i, "w w w", "s") for i in range(4000)], "doc_id long, text string, source string")
    labels = frame(spark, [(i, i % 2) for i in range(4000)], "doc_id long, quality int")
    got = mixing.mix(df, labels, share=0.5).collect()
    good, poor = (sum(x["taken"] for x in got if x["doc_id"] % 2 == q) for q in (1, 0))
    assert good > 1.3 * poor


def test_mixed_rows_keep_their_columns(spark):
    """Clashing names, equal rows and rows without an id."""
    rows = [(i, "w " * (i % 7), ["a", "b", None][i % 3], i, "t", 5) for i in range(300)]
    rows += [(7, "w " * 50, "a", 1, "x", 1)] * 2 + [(None, f"no id {i}", "b", 2, "y", 2) for i in range(40)] + [(None, "no id 1", "b", 2, "z", 3), (400, None, None, None, None, None)]
    df = frame(spark, rows, "doc_id long, text string, source string, size int, taken string, _taken int")
    labels = frame(spark, [(i, i % 2) for i in range(0, 300, 2)] + [(None, 1)], "doc_id long, quality int")
    got = mixing.mix_rows(df, labels)
    assert got.columns == [*df.columns, "mix_size", "copies", "partial", "mix_taken"]
    out = got.collect()
    # What the mix says of each row is what mix() says of it, equal rows aside.
    whole = {(r["doc_id"], r["size"]): r["taken"] for r in mixing.mix(df.select("doc_id", "text", "source").distinct(), labels).collect() if r["doc_id"] not in (7, None)}
    close = sum(r["mix_taken"] == whole[r["doc_id"], r["mix_size"]] for r in out if r["doc_id"] not in (7, None))
    assert close > 0.9 * len([r for r in out if r["doc_id"] not in (7, None)])
    for r in out:
        assert r["mix_size"] == len((r["text"] or "").split()) and r["mix_taken"] == (r["copies"] + r["partial"]) * r["mix_size"]
    sizes = {}
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + len((r[1] or "").split())
    target = fill(sizes)
    for s in sizes:
        assert abs(sum(r["mix_taken"] for r in out if r["source"] == s) - target[s]) <= 50
    pair = [r["mix_taken"] for r in out if r["doc_id"] == 7 and len(r["text"]) == 100]
    assert len(pair) in (0, 2) and len(set(pair)) <= 1
    assert mixing.mix_rows(df.where("false"), labels).count() == 0


def test_labels_are_not_broadcast(spark):
    labels = frame(spark, [(1, 1)], "doc_id long, quality int")
    df = frame(spark, [(1, "a b", "s"), (None, "c", "s")], "doc_id long, text string, source string")
    plans = []
    original = mixing.WorkArea.write

    def write(self, out, name, codec="zstd"):
        plans.append((name, out._jdf.queryExecution().executedPlan().toString()))
        return original(self, out, name, codec)

    mixing.WorkArea.write = write
    try:
        mixing.mix(df, labels).collect()
    finally:
        mixing.WorkArea.write = original
    assert "BroadcastHashJoin" not in dict(plans)["keyed"] and "SortMergeJoin" in dict(plans)["keyed"]


# --- decontamination ---

QUESTION = "which river crosses the old northern market town before it meets the grey sea"
ANSWER = "the long silver river called ander"
ITEM = f"{QUESTION}\n{ANSWER}"


def items(spark, *texts):
    return frame(spark, list(enumerate(texts)), "item_id long, text string")


def filler(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(3)) for _ in range(n))


OTHERS = [filler(i, 30) for i in range(40)]


def test_planted_items_are_found(spark):
    texts = [
        f"{filler(100, 300)} {ITEM} {filler(101, 300)}",
        " ".join(f"{w}***" for w in ITEM.upper().split()),
        f"{filler(102, 50)} {QUESTION} {filler(103, 50)}",
        filler(104, 3000),
        "",
        None,
        f"{filler(105, 40)} {OTHERS[3]}, {OTHERS[4]}",
    ]
    df = frame(spark, [(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x")], "doc_id long, text string, item_id string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, items(spark, ITEM, *OTHERS, None, "", "it was", "it was")).collect()}
    assert got == {(0, 0), (1, 0), (6, 4), (6, 5)}
    kept = decontaminate.keep_clean(df, items(spark, ITEM, *OTHERS))
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4, 5]
    assert decontaminate.contaminated(df, items(spark, ITEM).where("false")).count() == 0
    assert decontaminate.contaminated(df.where("false"), items(spark, ITEM)).count() == 0


def every_score(texts, n, mean, count):
    """Impacts of all items by word, in plain Python: item -> word -> share of the item's own score."""
    import math

    out = []
    for t in texts:
        words = decontaminate.tokens(t)
        raw = {w: math.log(1 + (n - count[w] + 0.5) / (count[w] + 0.5)) * words.count(w) * 2.2 / (words.count(w) + 1.2 * (0.25 + 0.75 * len(words) / mean)) for w in set(words)}
        out.append({w: v / sum(raw.values()) for w, v in raw.items()})
    return out


@pytest.mark.parametrize("vocabulary, items", [(60, 50), (400, 300), (25, 9)])
def test_retrieval_against_every_score(vocabulary, items):
    import numpy as np

    r = random.Random(items)
    words = [f"w{i}" for i in range(vocabulary)]
    texts = [" ".join(r.choices(words, weights=[1 / (i + 1) for i in range(vocabulary)], k=r.randint(5, 25))) for _ in range(items)]
    count = {}
    for t in texts:
        for w in set(t.split()):
            count[w] = count.get(w, 0) + 1
    mean = sum(len(t.split()) for t in texts) / len(texts)
    index = decontaminate.Index(list(enumerate(texts)), len(texts), mean, count, stride=25)
    scores = every_score(texts, len(texts), mean, count)
    docs = [" ".join([*r.choices(words, k=r.randint(0, 90)), r.choice(texts), *r.choices(words, k=r.randint(0, 30))]).split() for _ in range(40)] + [[]]
    ids = [np.array([index.terms.get(w, -1) for w in d], np.int32) for d in docs]
    some = 0
    for threshold in (0.3, 0.5, 0.65, 0.8):
        got = {(d, s, i): x for d, s, i, x in index.retrieve(ids, threshold)}
        want = {}
        for d, t in enumerate(docs):
            for s in range(0, max(1, len(t) - 25), 25):
                have = set(t[s : s + 50])
                for i, own in enumerate(scores):
                    x = sum(v for w, v in own.items() if w in have)
                    if x >= threshold - decontaminate.EPSILON:
                        want[d, s, i] = x
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-4 for k in got)
        # The cursors alone, without the batch's bounds, give the same.
        alone = {(d, s, i) for d, t in enumerate(ids) for s in range(0, max(1, len(t) - 25), 25) if len(k := np.unique(t[s : s + 50][t[s : s + 50] >= 0])) for i, _ in index.wand(k, threshold)}
        assert alone == set(want)
        some += len(want)
    assert some > 40


def test_blocks_are_skipped():
    """The pivot leaves most items of common words unscored."""
    r = random.Random(3)
    texts = [f"common word {' '.join(f'rare{i}x{j}' for j in range(12))}" for i in range(400)]
    count = {}
    for t in texts:
        for w in t.split():
            count[w] = count.get(w, 0) + 1
    index = decontaminate.Index(list(enumerate(texts)), 400, 14, count)
    import numpy as np

    words = texts[77].split() + ["common"] * 5 + [f"rare{r.randrange(400)}x{j}" for j in range(6)]
    query = np.unique([index.terms[w] for w in words])
    assert [i for i, _ in index.wand(query, 0.65)] == [77]
    assert len(index.possible([query, query[:2]], 0.65)) == 1


def test_shards_give_the_same(spark, monkeypatch):
    df = frame(spark, [(1, f"a b {ITEM} c"), (2, OTHERS[7]), (None, OTHERS[7]), (None, f"x {OTHERS[8]}")])
    pairs = lambda: sorted(map(str, decontaminate.contaminated(df, items(spark, ITEM, *OTHERS)).select("doc_id", "item_id").collect()))
    whole = pairs()
    monkeypatch.setattr(decontaminate, "SHARD_CHARACTERS", 500)
    parts = pairs()
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 3000)
    monkeypatch.setattr(decontaminate, "PASS_BYTES", 8000)
    made = decontaminate.build(items(spark, ITEM, *OTHERS), decontaminate.WorkArea(spark, "test"))
    groups = list(decontaminate.passes(made))
    # Nothing that is broadcast at once is larger than the bound, and every item is in one index.
    assert len(groups) > 2 and all(sum(map(len, g)) <= 8000 for g in groups)
    import pickle

    assert sorted(i for g in groups for x in g for i in pickle.loads(x).ids) == list(range(41))
    alone = pairs()
    assert whole == parts == alone and len(whole) == 4
    assert decontaminate.keep_clean(df, items(spark, ITEM, *OTHERS)).count() == 0


def test_long_items_and_long_texts(spark):
    long_item = filler(300, 700)
    df = frame(spark, [(1, f"{filler(301, 30_000)} {long_item} {filler(302, 500)}"), (2, filler(303, 2000)), (3, ITEM)])
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, items(spark, ITEM, long_item, *OTHERS)).collect()}
    assert got == {(1, 1), (3, 0)}


def test_query_against_plain_search(spark):
    """The registered query over the whole tables, against every shingle of every item in every passage."""
    from tidewrack.llm import queries

    folder = "/root/testdata/sf0.001"
    found = {(r["doc_id"], r["item_id"]) for r in queries.op3_benchmark_decontamination(spark, folder).collect()}
    docs = [(r["doc_id"], decontaminate.tokens(r["text"] or "")) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = set()
    for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        whole = decontaminate.tokens(r["text"])
        question, answer = decontaminate.split_item(r["text"])
        own = decontaminate.shingles(whole)
        for doc_id, words in docs:
            for s in range(0, max(1, len(words) - 64), 64):
                passage = words[s : s + 128]
                count = decontaminate.Counter(passage)
                if len(own & decontaminate.shingles(passage)) >= 0.8 * len(own) and decontaminate.held(question, count) >= 0.8 and decontaminate.held(answer, count) >= 0.8:
                    want.add((doc_id, r["item_id"]))
    assert found == want and want
