import hashlib
import random
import zlib

import numpy as np
import pytest

from tidewrack.llm import media, tokens


def corpus():
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgé") for _ in range(r.randint(1, 8)))
    long = " ".join(word() for _ in range(30_000))
    texts = [" ".join(word() for _ in range(r.randint(1, 400))) for _ in range(20)]
    return [*texts, texts[0], long, long[:90_000] + "X" + long[90_000:], "", None, "x" * 64, "日本語" * 50]


def test_round_trip(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, digest int")
    got = {r["doc_id"]: r for r in media.digest_columns(spark, df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-64:]) and r["media_bytes"] == len(payload) + 44
        assert r["media_sha256"] == hashlib.sha256(media.encode(data)).hexdigest()
    assert got[0]["feature"] == got[20]["feature"]


def test_cuts_follow_content():
    data = random.Random(1).randbytes(400_000)
    a, b = media.cut(data), media.cut(b"inserted" + data)
    assert a[-1] == len(data) and max(np.diff([0, *a])) <= media.LARGEST and min(np.diff([0, *a])[:-1]) >= media.SMALLEST
    assert len({len(data) - x for x in a} & {len(data) + 8 - x for x in b}) > 0.8 * len(a)


def test_known_chunks_are_not_stored_again(spark):
    df = spark.createDataFrame([(1, "a" * 5000), (2, "b" * 5000)], "doc_id long, text string")
    first = media.store(df, b"")
    assert media.store(df, b"", first).count() == 0
    more = media.store(df.unionByName(spark.createDataFrame([(3, "c" * 5000)], "doc_id long, text string")), b"", first)
    assert 0 < more.count() <= first.count()


def test_damage_is_noticed(spark):
    df = spark.createDataFrame([(1, "hello there")], "doc_id long, text string")
    listed, chunks = media.manifests(df), media.store(df, b"")
    with pytest.raises(Exception):  # noqa: B017
        media.rebuild(listed.select("media", "digests"), chunks.where("false"), b"").collect()


def test_the_dictionary_needs_few_bytes_of_a_long_text(spark):
    """One id that many rows share, rows without an id and a very long text: the sample stays small, the store whole."""
    rows = [(1, "same id " * 50 + str(i)) for i in range(50)] + [(None, f"no id {i}") for i in range(50)] + [(i, " ".join(str(j * i) for j in range(60_000))) for i in (2, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert isinstance(media.fit_dictionary(df), bytes) and media.fit_dictionary(df.where("false")) == b""
    before = {t.name for t in spark.catalog.listTables()}
    got = media.digest_columns(spark, df).collect()
    assert sorted((r["n_bytes"], r["payload_sha256"]) for r in got) == sorted((len(t), hashlib.sha256(t.encode() + bytes(-len(t) % 64)).hexdigest()) for _, t in rows)
    assert {t.name for t in spark.catalog.listTables()} == before


def test_query_against_plain_reading(spark):
    """The registered query over every document of sf0.01."""
    from tidewrack.llm import queries

    folder = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op2_media_chunks(spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        data = texts[r["doc_id"]]
        payload = data + bytes(-len(data) % 64 if data else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_empty_table(spark):
    assert media.digest_columns(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder()


TEXTS = ["", "one line", "two\nlines\n", "\n\n\nx\n", "é日本\n語🙂🙂\nfin", "<|endoftext|> is text", "a" * 3000 + "\n" + "1234567890 " * 50, "tab\t\tand   spaces  \n\n  end"]


def test_spans_agree_with_another_tokenizer(encoder):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    other.encode_special_tokens = True
    for t in TEXTS:
        starts, ends = encoder.spans(t)
        want = other.encode(t, add_special_tokens=False)
        assert len(starts) == len(want.ids)
        if t.isascii():
            assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == want.offsets


def plain(starts, ends, sections, rule):
    counts, outside = [0.0] * len(sections), 0.0
    for a, b in zip(starts, ends, strict=True):
        held = [(max(0, min(b, y) - max(a, x)), -i) for i, (x, y) in enumerate(sections)]
        if rule == "start":
            own = [i for i, (x, y) in enumerate(sections) if x <= a < y]
            if own:
                counts[own[0]] += 1
            else:
                outside += 1
        elif rule == "majority":
            n, i = max(held, default=(0, 0))
            if n > 0:
                counts[-i] += 1
            else:
                outside += 1
        else:
            for n, i in held:
                counts[-i] += n / (b - a)
            outside += 1 - sum(n for n, _ in held) / (b - a)
    return counts, outside


@pytest.mark.parametrize("rule", tokens.RULES)
def test_allocation_against_plain_version(encoder, rule):
    r = random.Random(6)
    for t in TEXTS:
        starts, ends = encoder.spans(t)
        cuts = sorted(r.choice(range(len(t) + 1)) for _ in range(8))
        for sections in (list(zip([0, *tokens.line_ends(t)[:-1].tolist()], tokens.line_ends(t).tolist(), strict=True)), list(zip(cuts[::2], cuts[1::2], strict=True))):
            counts, _, outside = tokens.allocate(starts, ends, sections, rule)
            want, beyond = plain(starts.tolist(), ends.tolist(), sections, rule)
            assert np.allclose(counts, want) and abs(outside - beyond) < 1e-6
            assert abs(counts.sum() + outside - len(starts)) < 1e-6


def test_attribution_in_spark(spark, encoder):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(None, None), (3, "again\nand again")], "doc_id long, text string")
    got = tokens.attribute(df, "majority", encoder)
    totals = {r["doc_id"]: r["s"] for r in got.groupBy("doc_id").sum("tokens").withColumnRenamed("sum(tokens)", "s").collect()}
    assert all(totals[i] == len(encoder.spans(t)[0]) for i, t in enumerate(TEXTS) if i != 3) and totals[None] == 0
    fields = tokens.join_fields(spark.createDataFrame([(1, "a title", None, "body text")], "doc_id long, t string, u string, b string"), ["t", "u", "b"])
    rows = tokens.attribute(fields, "start", encoder, sections="field_spans").orderBy("section").collect()
    assert [r["tokens"] for r in rows if r["section"] >= 0] == [2, 0, 2]
    assert tokens.attribute(df.where("false")).count() == 0


def test_a_missing_vocabulary_is_named():
    with pytest.raises(ValueError, match="/nowhere/at.all"):
        tokens.Encoder("/nowhere/at.all")


@pytest.mark.parametrize("run", [" ", "\n", "\t", "x", "\u3000"])
@pytest.mark.parametrize("around", [("", ""), ("word ", "word"), ("word", "\nword  "), ("\n", "'s")])
def test_long_runs_give_the_same_tokens(run, around):
    encoder = tokens.Encoder()
    encoding, _ = tokens._encoder(encoder.ranks, encoder.pattern, encoder.key)
    for n in (9_999, 10_000, 30_000):
        text = around[0] + run * n + around[1]
        assert tokens.encode(encoding, text) == encoding.encode_ordinary(text)


@pytest.mark.parametrize("run", [" ", "\n", "\t", "x"])
def test_two_million_of_one_character(spark, run):
    n = 2_000_000
    df = spark.createDataFrame([(1, "a" + run * n)], "doc_id long, text string")
    encoder = tokens.Encoder()
    encoding, _ = tokens._encoder(encoder.ranks, encoder.pattern, encoder.key)
    # What merges depends on few neighbours, so longer runs add the same tokens for each further stretch.
    small = [len(encoding.encode_ordinary("a" + run * k)) for k in (100_000, 200_000)]
    assert tokens.attribute(df).agg({"tokens": "sum"}).first()[0] == small[0] + (small[1] - small[0]) * (n - 100_000) / 100_000


def test_registered_query_against_a_plain_version(spark):
    """Tokens of the whole table of sf0.01, token by token and character by character."""
    from tidewrack.llm.queries import op4_token_counts

    folder = "/root/testdata/sf0.01"
    got = {}
    for r in op4_token_counts(spark, folder).collect():
        got.setdefault(r["doc_id"], {})[r["section"]] = (r["start"], r["end"], r["tokens"], r["crossing"])
    encoder = tokens.Encoder()
    encoding, _ = tokens._encoder(encoder.ranks, encoder.pattern, encoder.key)
    for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        text = r["text"] or ""
        line_of, owner, line = [], [], 0  # of characters, and the character of each byte
        for i, c in enumerate(text):
            line_of.append(line)
            owner += [i] * len(c.encode())
            line += c == "\n"
        lines = line + (not text.endswith("\n"))
        counts, crossing, at = [0] * lines, [0] * lines, 0
        for t in encoding.encode_ordinary(text):
            size = len(encoding.decode_single_token_bytes(t))
            held = [line_of[i] for i in sorted({owner[b] for b in range(at, at + size)})]
            at += size
            counts[max(sorted(set(held)), key=held.count)] += 1
            if len(set(held)) > 1:
                for k in set(held):
                    crossing[k] += 1
        mine = got[r["doc_id"]]
        assert [(mine[i][2], mine[i][3]) for i in range(lines)] == list(zip(counts, crossing, strict=True)) and len(mine) == lines
        assert "".join(text[mine[i][0] : mine[i][1]] for i in range(lines)) == text
