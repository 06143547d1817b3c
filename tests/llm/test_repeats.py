import hashlib
import random

import numpy as np
import pytest

from tidewrack.llm import repeats


def words(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


def check(spark, texts, **kw):
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in repeats.deduplicate(df, **kw).collect()}
    want = repeats.brute_force([(t or "").encode() for t in texts], kw.get("length", repeats.LENGTH))
    assert got == dict(enumerate(want))
    return want


def test_against_brute_force(spark):
    r = random.Random(3)
    passage, texts = words(r, 150), []
    for _ in range(12):
        t = words(r, r.randint(5, 200))
        if r.random() < 0.6:
            a, b = sorted(r.sample(range(len(passage)), 2))
            t += " " + passage[a:b] + " " + words(r, r.randint(0, 60))
        texts.append(t)
    texts += [texts[0], texts[0], texts[1][:500] + "ü" + texts[1][500:], passage + passage, "", None, "a" * 399, "short"]
    want = check(spark, texts)
    assert sum(n for n, _, _ in want) > 3000


@pytest.mark.parametrize("text", ["a" * 1000, "ab" * 300, "x" * 400 + "y" * 400, "the the the of of " * 60])
def test_texts_that_repeat_themselves(spark, text):
    check(spark, [text, "b" * 500, words(random.Random(1), 100)])


def test_other_lengths(spark):
    r = random.Random(9)
    base = words(r, 80)
    check(spark, [base, base[100:300], base[50:], words(r, 40) + base[20:180]], length=120, reach=60)


def test_units_cover_every_start_once():
    r = random.Random(4)
    for text in (words(r, 200), "a" * 900, "xyz" * 200):
        raw = np.frombuffer(text.encode(), np.uint8)
        lo, hi, at = repeats.units(raw)
        assert lo[0] == 0 and hi[-1] == len(raw) - 400 and (lo[1:] == hi[:-1] + 1).all() and (at >= hi).all() and (at - lo <= repeats.REACH).all()


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.deduplicate(df).count() == 0
    rows = spark.createDataFrame([(None, "z" * 500), (7, "q" * 10), (7, "r" * 10)], "doc_id long, text string")
    assert sorted(r["n_removed"] for r in repeats.deduplicate(rows).collect()) == [0, 0, 500]


def test_all_documents_against_brute_force(spark):
    """The registered query over the whole table of sf0.01."""
    from tidewrack.llm import queries

    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    want = repeats.brute_force([(r["text"] or "").encode() for r in rows])
    got = {r["doc_id"]: r for r in queries.op8_repeated_bytes(spark, folder).collect()}
    assert len(got) == len(rows)
    for r, (removed, spans, digest) in zip(rows, want, strict=True):
        g = got[r["doc_id"]]
        assert (g["n_removed"], g["n_spans"], g["kept_sha256"], g["repeated"]) == (removed, spans, digest, removed > 0)
    assert sum(n > 0 for n, _, _ in want) > 50


def test_rows_that_share_an_id_or_a_text(spark):
    r = random.Random(12)
    a, b = words(r, 120), words(r, 120)
    df = spark.createDataFrame([(1, a), (1, b), (2, a + " tail"), (None, b[:300]), (None, "x" + b)], "doc_id long, text string")
    got = sorted((r["n_bytes"], r["n_removed"]) for r in repeats.deduplicate(df).collect())
    texts = [a, b, a + " tail", b[:300], "x" + b]
    assert got == sorted((len(t), n) for t, (n, _, _) in zip(texts, repeats.brute_force([t.encode() for t in texts]), strict=True))


def test_a_very_long_text(spark):
    r = random.Random(13)
    passage = words(r, 120)
    check(spark, [words(r, 40_000) + passage, passage, words(r, 10)])
