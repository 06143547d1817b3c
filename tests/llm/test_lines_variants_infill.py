"""Line dedup, spelling variants and fill-in-middle against plain Python, and their edge cases."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewrack.llm import infill, lines, queries, variants

SCHEMA = "doc_id long, text string, lines string, n int, a string, k int, of string, word string"


def frame(spark, rows):
    """Rows with further columns whose names clash with those that the operators make."""
    return spark.createDataFrame([(i, t, "x", 1, "y", 2, "z", "w") for i, t in rows], SCHEMA)


EDGES = [(1, None), (2, ""), (3, "\n"), (4, "  \n\tSame line \n"), (5, "same LINE"), (5, "same line"), (5, "same line"), (None, "same line"), (None, "same line"), (None, "same line\nÄ"), (6, "ä\n same line"), (7, "same line\n" * 30)]


def dropped_rows(df, **kw):
    return sorted(map(tuple, lines.deduplicate(df, **kw).collect()), key=repr)


def plain_rows(rows, **kw):
    return sorted(((i, *x) for (i, _), x in zip(rows, lines.brute_force(rows, **kw), strict=True)), key=repr)


@pytest.mark.parametrize("least", [1, 2, 4, 5, 6, 7])
def test_lines_of_few_rows(spark, least):
    assert dropped_rows(frame(spark, EDGES), least_documents=least) == plain_rows(EDGES, least_documents=least)


def test_lines_by_length(spark):
    rows = [(i, f"a\nab\nabc\n{i}") for i in range(4)]
    for chars in (0, 1, 2, 3, 4):
        assert dropped_rows(frame(spark, rows), least_documents=3, least_chars=chars) == plain_rows(rows, least_documents=3, least_chars=chars)


def test_lines_of_a_hot_key_and_a_long_text(spark):
    r = random.Random(5)
    rows = [(i, "\n".join(r.choice([" HOT", "hot", f"line {r.randint(0, 60)}", f"own {i} {j}", ""]) for j in range(r.randint(1, 12)))) for i in range(400)]
    rows.append((1000, "\n".join(f"line {i % 61}" if i % 3 else f"long {i}" for i in range(60_000))))
    got = plain_rows(rows)
    assert dropped_rows(frame(spark, rows)) == got and sum(x[2] for x in got) > 10_000


def test_lines_beside_the_hot_ones(spark, monkeypatch):
    monkeypatch.setattr(lines, "HOT_SHARE", 3)  # nearly all shared keys go through the join
    rows = [(i, f"common\nshared {i % 4}\nown {i}") for i in range(60)]
    assert dropped_rows(frame(spark, rows)) == plain_rows(rows)


def test_no_rows(spark):
    none = frame(spark, [])
    assert lines.deduplicate(none).count() == infill.transform(none).count() == variants.group(none).count() == 0
    blank = frame(spark, [(1, None), (2, ""), (None, " 12 ")])
    assert variants.group(blank).count() == 0 and infill.transform(blank).count() == 3


def edits(word, alphabet):
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in alphabet}
    out |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in alphabet}
    return out - {word}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abéz", min_size=1, max_size=6), min_size=1, max_size=5))
def test_neighbourhoods_are_whole_and_distinct(some):
    full = np.full(1 << (variants.TABLE_BITS - 3), 255, np.uint8)
    for same in variants.by_length(some).values():
        made = Counter(variants.near_strings(same, "abéz", full))
        want = Counter((w, x) for w in same for x in edits(w, "abéz"))
        assert made == want


def plain_groups(rows, length, count, ratio, every):
    n = Counter()
    for i, t in rows:
        text = (t or "").encode().lower().decode()
        run = ""
        for c in text + " ":
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
                continue
            if run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                n[run if h % every else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
            run = ""
    kept = {w: c for w, c in n.items() if len(w) >= length and c >= count}
    alphabet = set("".join(kept))
    near = {w: sorted(edits(w, alphabet) & kept.keys(), key=lambda x: (-kept[x], x)) for w in kept}
    form = {w: x[0] if x and kept[x[0]] >= ratio * kept[w] else None for w, x in near.items()}
    out = []
    for w in kept:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, kept[w], len(near[w]), kept[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def test_variants_against_brute_force(spark):
    r = random.Random(2)
    base = ["gramma", "écoles", "receive", "aabbcc", "straße", "çedille", "neighbour"]
    rows = []
    for i in range(300):
        some = []
        for _ in range(r.randint(0, 25)):
            w = r.choice(base[: r.randint(1, 7)])
            for _ in range(r.choice([0, 0, 0, 0, 1, 1, 2, 3])):
                w = r.choice(sorted(edits(w, "aeéß")))
            some.append(w.upper() if r.random() < 0.2 else w)
        rows.append((None if i % 50 == 7 else i // 2, r.choice([" ", "-", "1", "×", "\n"]).join(some) if i % 40 else None))
    for length, count, ratio, every in ((6, 5, 5, 199), (4, 2, 2, 7), (1, 1, 3, 3)):
        want = plain_groups(rows, length, count, ratio, every)
        got = sorted(map(tuple, variants.group(frame(spark, rows), length, count, ratio, every).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)
        assert got == want and len(want) > 20
    with pytest.raises(ValueError, match="above 1"):
        variants.group(frame(spark, rows), ratio=1)


def test_pairs_do_not_depend_on_the_table(spark, monkeypatch):
    """A full table lets every neighbour pass; the join alone then decides."""
    words = spark.createDataFrame([("abcd", 5), ("abce", 9), ("abc", 1), ("bcd", 2), ("xyz", 3), ("abcdd", 4)], "word string, n long")
    want = sorted(map(tuple, variants.neighbours(words).collect()))
    assert [p[:2] for p in want if p[0] == "abcd"] == [("abcd", "abc"), ("abcd", "abcdd"), ("abcd", "abce"), ("abcd", "bcd")]
    monkeypatch.setattr(variants, "bit_table", lambda v: b"\xff" * (1 << (variants.TABLE_BITS - 3)))
    assert sorted(map(tuple, variants.neighbours(words).collect())) == want


def test_roots_of_long_chains(spark):
    from tidewrack.llm.common import WorkArea

    steps = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(40)] + [("v", "w38")], "word string, form string")
    got = dict(map(tuple, variants.last_of(spark, steps, WorkArea(spark, "chains")).collect()))
    assert got == {**{f"w{i}": "w40" for i in range(40)}, "v": "w40"}


TEXTS = [None, "", " ", "\n\t ", "word", " word", "word ", "two words", "a  b\r\nc\x0bd\x0c ", "ä ö ü  x", "has <P> marker", "<S", "has<M>", "𝄞 clef 𝄞", "< P> <\nM>", "x" * 50]


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 4096])
def test_cuts_against_plain_tokens(spark, chunk):
    r = random.Random(chunk)
    rows = [(r.randint(0, 40), t) for t in TEXTS for _ in range(3)] + [(None, t) for t in TEXTS]
    rows += [(i, "".join(r.choice("ab \n\té𝄞") for _ in range(r.randint(0, 60)))) for i in range(150)]
    rows += [(8, "same row again")] * 40
    for rate in (100, 50):
        got = infill.transform(frame(spark, rows), rate=rate, chunk=chunk)
        got = got.withColumn("restored", infill.restore(F.col("output"), F.col("form"))).collect()
        want = sorted(((i, *infill.brute_force(i, t, rate=rate), t or "") for i, t in rows), key=repr)
        assert sorted(map(tuple, got), key=repr) == want
        assert {x[2] for x in want} == {"plain", "spm", "psm"}


def test_cuts_of_a_very_long_text(spark):
    text = "word and  word\n" * 400_000 + " \t"
    rows = [(i, text) for i in range(3)] + [(9, " " * 3_000_000), (10, "x" * 3_000_000)]
    got = sorted(map(tuple, infill.transform(frame(spark, rows), rate=100).collect()))
    assert got == [(i, *infill.brute_force(i, t, rate=100)) for i, t in rows]


def test_registered_queries_against_plain_python(spark):
    """The three queries over the whole tables of sf0.01, without their SQL."""
    import hashlib

    folder = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op11_line_dedup(spark, folder).collect()}
    assert got == {i: (n, m, digest(t)) for (i, _), (n, m, t) in zip(rows, lines.brute_force(rows), strict=True)}
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op13_fill_in_middle(spark, folder).collect()}
    want = {i: infill.brute_force(i, t) for i, t in rows}
    assert got == {i: (*want[i][:4], digest(want[i][4]), digest(t or "")) for i, t in rows}
    got = sorted(map(tuple, queries.op12_spelling_variants(spark, folder).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)
    assert got == plain_groups(rows, 6, 5, 5, 199)
