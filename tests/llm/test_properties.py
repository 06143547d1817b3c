"""Properties that hold for any input."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewrack.llm import htmltext, media, repeats, secrets, simhash, tokens

spans = st.lists(st.tuples(st.integers(0, 60), st.integers(1, 20)).map(lambda x: (x[0], x[0] + x[1])), max_size=12)


@given(spans)
def test_merged_spans_cover_the_same_bytes(given_spans):
    out = repeats.merge(given_spans)
    assert {i for a, b in out for i in range(a, b)} == {i for a, b in given_spans for i in range(a, b)}
    assert all(a[1] < b[0] for a, b in zip(out, out[1:], strict=False))


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=200), st.integers(1, 400))
def test_media_hold_their_bytes(data, times):
    whole = data * times
    stored = media.encode(whole)
    payload = media.decode(stored)
    assert payload[: len(whole)] == whole and not payload[len(whole) :].strip(b"\0") and len(payload) % 64 == 0 and payload
    assert b"".join(media._chunks(stored)) == stored


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abc é\n\t", max_size=6), max_size=30))
def test_fingerprints_ignore_blanks_and_ascii_case(words):
    text = " ".join(words)
    other = "\n\n".join(text.split(" ")).replace("a", "A")
    assert simhash.fingerprint(text.encode(), 3) == simhash.fingerprint(other.encode(), 3)
    assert (simhash.shingle_set(text.encode(), 2) == simhash.shingle_set(other.encode(), 2)).all()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 9), max_size=20), st.lists(st.integers(0, 15), max_size=8), st.sampled_from(tokens.RULES))
def test_no_token_is_lost_or_counted_twice(lengths, widths, rule):
    ends = np.cumsum(np.array(lengths, np.int64)) if lengths else np.zeros(0, np.int64)
    starts = ends - np.array(lengths, np.int64)
    edges = np.cumsum([0, *widths]).tolist()
    sections = list(zip(edges[:-1], edges[1:], strict=True))
    if sections:
        counts, _, outside = tokens.allocate(starts, ends, sections, rule)
        assert abs(counts.sum() + outside - len(lengths)) < 1e-9 and (counts >= 0).all()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class='ad'>", "</div>", "<a href=x>", "</a>", "<li>", "<ul>", "</ul>", "<script>", "</script>", "text &amp; more", "<!--", "-->", "<br>", "<table><tr><td>", "</table>", "<", "&#x;"]), max_size=25))
def test_any_markup_parses(parts):
    p = htmltext.parse("".join(parts))
    assert all(0 <= i < len(p.nodes) and t == " ".join(t.split()) for i, t in p.blocks)
    assert all(v.parent < i for i, v in enumerate(p.nodes))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab1 =:\"'/+_-\nAKIAtokenghp", max_size=120))
def test_candidates_are_disjoint_and_described(text):
    found = list(secrets.candidates(text))
    assert all(a < b for a, b, _ in found) and all(x[1] <= y[0] for x, y in zip(found, found[1:], strict=False))
    for a, b, _ in found:
        assert np.isfinite(secrets.describe(text, a, b)).all()
