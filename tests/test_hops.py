"""Stored responses, redirect chains and circles of pages, against plain Python."""

import gzip
import os
import random

import pytest

from tidewrack.operators import hops
from tidewrack.sources import responses

ANSWERS = "url string, status int, location string, content_type string, fetched string, body binary"


def answers(spark, rows):
    return spark.createDataFrame([(u, s, where, kind, "2026-01-02T03:04:05Z", body) for u, s, where, kind, body in rows], ANSWERS)


ROWS = [
    ("http://a.com/", 200, None, "text/html", b"<p>\xc3\xa9\r\n\r\nWARC/1.0\r\n</p>"), ("http://a.com/old", 301, "/", None, b"moved"), ("https://b.org:8080/x?y=1", 200, None, "application/pdf", b"%PDF"),
    ("https://b.org:8080/gone", 404, None, "text/html", b"no"), ("http://c.net/", 0, None, None, b"timed out"), ("http://a.com/empty", 200, None, "text/html", b""),
]


def test_store_and_read_back(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    responses.store(answers(spark, ROWS), path)
    got = {r["url"]: r for r in responses.read(spark, path).collect()}
    assert len(got) == len(ROWS)
    for url, status, location, kind, body in ROWS:
        r = got[url]
        keeps = status == 0 or (status < 400 and kind == "text/html")
        assert (r["status"], r["location"], r["content_type"], bytes(r["body"])) == (status, location, kind, body if keeps else b"")
        assert r["host"] == url.split("/")[2] and r["fetched"] == "2026-01-02T03:04:05Z"
    whole = {r["url"]: bytes(r["body"]) for r in responses.read(spark, path, bodies="all").collect()}
    assert whole == {u: b for u, *_, b in ROWS}
    assert sorted(os.listdir(f"{tmp_path}/store")) == ["_staging", "host=a.com", "host=b.org%3A8080", "host=c.net"] and not os.listdir(f"{tmp_path}/store/_staging")


def test_filters_reach_the_files(spark, tmp_path, capsys):
    path = f"file://{tmp_path}/store"
    responses.store(answers(spark, ROWS), path)
    for h in ("a.com", "c.net"):  # a folder that is not wanted is not opened
        for f in os.listdir(f"{tmp_path}/store/host={h}"):
            with open(f"{tmp_path}/store/host={h}/{f}", "wb") as out:
                out.write(b"no gzip")
    found = responses.read(spark, path).where("host = 'b.org:8080' and status in (200, 500)")
    assert [r["url"] for r in found.collect()] == ["https://b.org:8080/x?y=1"]
    found.explain("formatted")
    assert "EqualTo(host,b.org:8080)" in capsys.readouterr().out
    assert responses.read(spark, path).where("host = 'nowhere'").count() == 0
    assert responses.read(spark, path).where("host in ('b.org:8080', 'x') and url like '%gone' and status > 300").count() == 1


def test_columns_overwrite_and_refusals(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    responses.store(answers(spark, ROWS), path)
    assert responses.read(spark, path, "status int, url string").columns == ["status", "url"]
    responses.store(answers(spark, ROWS[:1]), path)
    assert responses.read(spark, path).count() == len(ROWS) + 1
    responses.store(answers(spark, ROWS[:2]), path, "overwrite")
    assert responses.read(spark, path).count() == 2
    with pytest.raises(Exception, match="no columns"):
        responses.read(spark, path, "nothing int").count()
    with pytest.raises(Exception, match="need a url"):
        spark.createDataFrame([(1,)], "status int").write.format("stored_responses").mode("append").save(path)


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    responses.store(answers(spark, ROWS[:1]), path)
    bad = answers(spark, ROWS).selectExpr("url", "if(url like '%gone', raise_error('stop'), status) as status", "body")
    with pytest.raises(Exception, match="stop"):
        responses.store(bad, path)
    assert responses.read(spark, path).count() == 1


def test_archives_of_others(spark, tmp_path):
    """Records of several kinds, packed bodies, odd headers."""
    body = b"<html>\xe2\x82\xac</html>"
    packed = gzip.compress(body)
    http = b"HTTP/1.1 200 OK\r\ncontent-type: TEXT/HTML\r\nContent-Encoding: gzip\r\nX: 1\r\nX: 2\r\n\r\n" + packed
    broken = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Encoding: gzip\r\n\r\nplain"
    out = b""
    for kind, url, content in (("warcinfo", "", b"software: x\r\n"), ("request", "http://a.com/", b"GET / HTTP/1.1\r\n\r\n"), ("response", "<http://a.com/>", http), ("response", "http://A.com/2", broken), ("response", "http://a.com/3", b"\r\n")):
        out += f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nContent-Length: {len(content)}\r\n\r\n".encode() + content + b"\r\n\r\n"
    folder = tmp_path / "host=a.com"
    folder.mkdir()
    (folder / "x.warc").write_bytes(out)
    got = {r["url"]: r for r in responses.read(spark, str(tmp_path)).collect()}
    assert bytes(got["http://a.com/"]["body"]) == body and bytes(got["http://A.com/2"]["body"]) == b"plain" and got["http://a.com/3"]["status"] == 0 and len(got) == 3
    assert {r["host"] for r in got.values()} == {"a.com"}


def walk(rows):
    to = {}
    for u, s, w in rows:
        if u is not None and w is not None and (u not in to or w < to[u][0]):
            to[u] = (w, f"{s} → {w}")
    out = {}
    for u in to:
        seen, at, chain = {u}, u, []
        while at in to:
            chain.append(to[at][1])
            at = to[at][0]
            if at in seen:
                out[u] = (None, None, True)
                break
            seen.add(at)
        else:
            out[u] = (at, len(chain), False, chain)
    return out


@pytest.mark.parametrize("n", [1, 2, 40, 1000])
def test_chains_of_any_length(spark, n):
    rows = [(f"c{i}", 301, f"c{i + 1}") for i in range(n)] + [("a", 302, "b"), ("b", 302, "a"), ("in", 301, "a"), ("self", 301, "self"), ("c0", 301, "z"), (None, 301, "x"), ("y", 301, None), ("hot", 301, f"c{n}")]
    want = walk(rows)
    got = {r["url"]: r for r in hops.follow(spark.createDataFrame(rows, "url string, status int, location string")).collect()}
    assert got.keys() == want.keys()
    for u, w in want.items():
        assert (got[u]["final"], got[u]["hops"], got[u]["loop"]) == w[:3]
        if not w[2]:
            assert got[u]["chain"] == w[3]
    assert got["a"]["chain"][:2] == ["302 → b", "302 → a"]
    verdicts = {r["url"]: r["verdict"] for r in hops.chain_findings(spark.createDataFrame([("x", 2, False), ("y", 3, False), ("z", None, True)], "url string, hops long, loop boolean")).collect()}
    assert verdicts == {"x": "ok", "y": "too-long", "z": "loop"}


def test_many_chains_that_meet(spark):
    r = random.Random(4)
    rows = [(f"n{i}", 301, f"n{r.randint(0, 400)}") for i in range(400) if r.random() < 0.9]
    want = walk(rows)
    got = {x["url"]: (x["final"], x["hops"], x["loop"]) for x in hops.follow(spark.createDataFrame(rows, "url string, status int, location string")).collect()}
    assert got == {u: w[:3] for u, w in want.items()} and any(w[2] for w in want.values())


def test_no_hops(spark):
    none = spark.createDataFrame([], "url string, status int, location string, body binary")
    assert hops.follow(none).count() == 0 and hops.fetched(none).count() == 0 and hops.circles(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_what_a_client_gets(spark):
    rows = [("http://a.com/1", 301, "2?x", b""), ("http://a.com/2?x", 302, "//b.com/", b"m"), ("http://b.com/", 200, None, b"page"), ("http://a.com/lost", 301, "http://nowhere/", b""), ("http://a.com/r", 307, "/r", b"x"), ("http://a.com/e", 500, None, b"err"), ("http://a.com/n", 304, "/", b"kept")]
    got = {r["url"]: (r["code"], r["final_url"], bytes(r["body"]), r["loop"], len(r["chain"])) for r in hops.fetched(spark.createDataFrame(rows, "url string, status int, location string, body binary")).collect()}
    assert got["http://a.com/1"] == (200, "http://b.com/", b"page", False, 2) and got["http://b.com/"] == (200, "http://b.com/", b"page", False, 0)
    assert got["http://a.com/lost"] == (0, "http://nowhere/", b"", False, 1) and got["http://a.com/r"] == (307, "http://a.com/r", b"", True, 1)
    assert got["http://a.com/e"] == (500, "http://a.com/e", b"", False, 0) and got["http://a.com/n"] == (304, "http://a.com/n", b"kept", False, 0)


def plain_circles(edges):
    nodes = {x for e in edges for x in e}
    reach = {n: {n} for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if not reach[b] <= reach[a]:
                reach[a] |= reach[b]
                changed = True
    groups = {n: sorted(m for m in reach[n] if n in reach[m]) for n in nodes}
    return {(n, g[0], len(g)) for n, g in groups.items() if len(g) > 1}


@pytest.mark.parametrize("seed", range(4))
def test_circles_against_reachability(spark, seed):
    r = random.Random(seed)
    edges = [(r.randint(0, 50), r.randint(0, 50)) for _ in range(r.choice([30, 60, 80, 120]))] + [(100, 101), (101, 100), (7, 7)]
    assert {tuple(x) for x in hops.circles(spark.createDataFrame(edges, "src long, dst long")).collect()} == plain_circles(edges)


def test_crossed_canonicals(spark):
    rows = [("http://a.com/x", "/y"), ("http://a.com/y/", "http://a.com/x#top"), ("http://a.com/z", "/z"), ("http://a.com/p", "/x"), ("http://a.com/q", None)]
    got = {tuple(x) for x in hops.crossed(spark.createDataFrame(rows, "url string, canonical string")).collect()}
    assert got == {("http://a.com/x", "http://a.com/x", 2), ("http://a.com/y", "http://a.com/x", 2)}


def test_chains_over_addresses_without_a_page(spark, tmp_path):
    """The query's chains run on where no page has the number of an address: at the last page and in gaps."""
    duckdb = pytest.importorskip("duckdb")
    from tidewrack.plans.registry import ORACLES
    from tidewrack.plans import queries  # noqa: F401

    rows = [(n, f"<p>{n}</p>") for n in (0, 1, 2, 3, 5, 10, 13, 16, 99, 100, 101)]
    spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = c.execute(ORACLES["fetched_pages"])
    names = [d[0] for d in want.description]
    assert sorted(tuple(r[n] for n in names) for r in queries.QUERIES["fetched_pages"](spark, str(tmp_path)).collect()) == sorted(want.fetchall())
