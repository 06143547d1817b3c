import duckdb
import pytest

import corpus_pipeline


LARGER = "/root/testdata/sf0.01"


def test_stages(spark):
    small = LARGER
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, ids = docs.columns, [{r["doc_id"] for r in docs.select("doc_id").collect()}]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small).cache()
        ids.append({r["doc_id"] for r in out.select("doc_id").collect()})
        assert ids[-1] <= ids[-2] and len(ids[-1]) == out.count()
        if name != "source_mixing":
            assert out.columns == columns
        docs = out
    assert "taken" in docs.columns and docs.where("taken > 0").count() > 0
    assert docs.where("text rlike 'token = \"[0-9a-f]{40}\"'").count() == 0
    toxic = {i for (i,) in duckdb.sql(f"select doc_id from '{small}/labels.parquet' where toxic = 1").fetchall()}
    assert len(toxic & ids[1]) < 0.4 * len(toxic)
    assert len(ids[0] - ids[1] - toxic) < 0.1 * len(ids[0])
    assert ids[3] == ids[4], "secrets are masked, documents stay"
    texts = docs.groupBy("text").count()
    assert texts.where("count > 1").count() == 0


def test_run_is_the_stages(spark, small):
    out = corpus_pipeline.run(spark, small)
    assert out.count() > 0 and {"doc_id", "text", "taken"} <= set(out.columns)


def test_edge_rows_in_every_stage(spark):
    words = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, words, "en", "a", 5), (1, words, "en", "a", 5), (2, None, None, None, None), (3, "", "en", "b", 0), (None, words, "en", "a", 5), (None, words, "en", "a", 5), (4, words.upper(), None, "a", 1), (5, "w " * 60_000, "en", "b", 1)]
    docs = spark.createDataFrame([(*r, 0.5, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, size string")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, LARGER)
        got = out.collect()
        if name != "source_mixing":
            assert out.columns == docs.columns
        if name == "simhash_near_dedup":
            assert sorted(str(r["doc_id"]) for r in got) == ["1", "2", "5"]
        elif name != "source_mixing":
            assert len(got) == len(rows)
        empty = stage(spark, docs.where("false"), LARGER)
        assert empty.count() == 0


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", LARGER])
def test_near_dedup_against_every_pair(spark, folder):
    """The stage over the whole table keeps one document of each component of pairs at 0.8 or more, of all pairs there are."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    sets = {}
    for r in docs.select("doc_id", "text").collect():
        words = (r["text"] or "").encode().lower().split()
        sets[r["doc_id"]] = frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids, links = sorted(sets, key=lambda i: len(sets[i])), 0
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if len(x) < 0.8 * len(y) - 1e-9:
                break  # longer ones are further off
            both = len(x & y)
            if both >= 0.8 * (len(x) + len(y) - both) - 1e-9:
                low, high = sorted((root(a), root(b)))
                parent[high], links = low, links + 1
    kept = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, folder).select("doc_id").collect()}
    assert kept == {i for i in sets if root(i) == i} and links > 10


def test_stages_one_by_one_against_plain_versions(spark):
    """Decontamination, secrets and mixing over the whole table, each against what a plain reading of its input says."""
    from tidewrack.llm import decontaminate, secrets

    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    items = [r["text"] for r in spark.read.parquet(f"{LARGER}/benchmark.parquet").collect()]
    hit = set()
    for i, t in texts.items():
        words = decontaminate.tokens(t)
        grams = decontaminate.shingles(words)
        for item in items:
            own = decontaminate.shingles(decontaminate.tokens(item))
            if len(own & grams) == len(own):
                hit.add(i)
    clean = {r["doc_id"] for r in stages["benchmark_decontamination"](spark, docs, LARGER).collect()}
    assert hit and not hit & clean and len(texts) - len(clean) < len(hit) + 0.02 * len(texts)
    masked = {r["doc_id"]: r["text"] or "" for r in stages["secret_scan"](spark, docs, LARGER).collect()}
    scanner = secrets.fit(docs)
    for i, t in texts.items():
        for a, b, _, score in reversed(scanner.findings(t)):
            t = t[:a] + "[SECRET]" + t[b:] if score >= secrets.SECRET else t
        assert masked[i] == t
    mixed = stages["source_mixing"](spark, docs, LARGER)
    want = {r[0]: r[1] for r in duckdb.sql(corpus_mix()).fetchall()}
    got = {r["doc_id"]: r["taken"] for r in mixed.collect()}
    assert got == {i: n for i, n in want.items() if i in got} and sum(got.values()) == sum(want.values())


def corpus_mix():
    from tidewrack.llm import mixing

    for t in ("documents", "labels"):
        duckdb.sql(f"create or replace view {t} as select * from '{LARGER}/{t}.parquet'")
    return f"select doc_id, taken from ({mixing.ORACLE})"
