"""Two-sided fixtures: each rule has rows that pass and rows that fail for the right reason."""

import json

import pytest
from pyspark.sql import functions as F

from tidewrack.functions import numbers, text, urls
from tidewrack.operators import graph, logs, migrate, redirects, rules, scoring, sinks, snapshot, table
from tidewrack.sources import documents, pages, sitemaps
from tidewrack.sources import logs as log_lines
from tidewrack.streaming import logs as stream


def values(df, column=0):
    return [r[column] for r in df.collect()]


def one(spark, expression):
    return spark.range(1).select(expression).first()[0]


# --- logs ---


def line(ua, code, path="/a"):
    return f'1.2.3.4 - - [01/Jan/2026:00:00:00 +0000] "GET {path} HTTP/1.1" {code} 12 "-" "{ua}"'


@pytest.fixture(scope="module")
def log(spark):
    rows = [line("Mozilla GPTBot/1.0", 200), line("gptbot", 200), line("ClaudeBot", 200), line("ClaudeBot", 403, "/b"), line("ClaudeBot", 403, "/b"), line("Mozilla Firefox", 200), line("OtherBot", 200), "broken line", "  "]
    return log_lines.parse(spark.createDataFrame([(r,) for r in rows], "line string")).withColumn("agent", logs.first_agent(F.col("user_agent"))).withColumn("category", logs.first_agent(F.col("user_agent"), field=2))


def test_log_breakdown(log):
    got = {r["agent"]: r for r in logs.breakdown(log).collect()}
    assert {a: r["hits"] for a, r in got.items()} == {"GPTBot": 2, "ClaudeBot": 3}
    assert got["ClaudeBot"]["failure_rate"] == 0.667 and got["ClaudeBot"]["suspect"] and not got["GPTBot"]["suspect"]
    assert {r["category"] for r in log.where("agent is not null").collect()} == {"entrainement"}


def test_log_counters_and_samples(log):
    row = log_lines.counters(log, agent="agent").first()
    assert (row["read"], row["recognised"], row["ignored"], row["samples"]) == (8, 5, 1, ["broken line"])


def test_no_log_is_not_zero(spark):
    row = logs.not_measurable(spark, "logs", "access log", "give one").first()
    assert row["read"] is None and row["verdict"] == "non-mesurable"


def test_a_gap_never_replaces_a_measure(spark):
    runs = spark.createDataFrame([("a", "2026-01-01", True), ("a", "2026-01-02", False)], "source string, date string, measured boolean")
    assert logs.latest_measured(runs, ["source"]).first()["date"] == "2026-01-01"


def test_first_match_join_keeps_order(spark, log):
    met = logs.first_match(log.drop("agent"), "user_agent", logs.agent_catalogue(spark), ["agent"])
    assert met.where("agent = 'ClaudeBot'").count() == 3


# --- scalars ---


@pytest.mark.parametrize(("url", "want"), [("http://A.com", "http://A.com/"), ("http://a.com/", "http://a.com/"), ("http://a.com/x/", "http://a.com/x"), ("http://a.com/x//", "http://a.com/x/"), ("http://a.com/x/?q=1#f", "http://a.com/x?q=1"), ("http://a.com?q", "http://a.com/?q"), ("/x/", "/x")])
def test_normalise(spark, url, want):
    assert one(spark, urls.normalise(F.lit(url))) == want


@pytest.mark.parametrize(("ref", "want"), [("/b", "http://a.com/b"), ("//c.com/d", "http://c.com/d"), ("http://e.com/", "http://e.com/"), ("f", "http://a.com/x/f"), ("../g", "http://a.com/g")])
def test_resolve(spark, ref, want):
    assert one(spark, urls.resolve(F.lit("http://a.com/x/y"), F.lit(ref))) == want


@pytest.mark.parametrize(("path", "want"), [("/", "accueil"), ("/blog/a", "article"), ("/produit/x", "produit"), ("/contact", "service"), ("/panier", "transactionnel"), ("/x", "page")])
def test_template(spark, path, want):
    assert one(spark, urls.template(F.lit(path))) == want


def test_text_functions(spark):
    assert one(spark, text.slug(F.lit("L'Été à Nîmes !"))) == "l-ete-a-nimes"
    assert one(spark, text.ids_with_ranges(F.lit("3, 35-38"))) == [3, 35, 36, 37, 38]
    assert one(spark, text.ids_in_cell(F.lit("74, 25;66"))) == [74, 25, 66]
    assert one(spark, text.clean_null(F.lit(' "None" '))) is None and one(spark, text.clean_null(F.lit("x"))) == "x"
    assert one(spark, text.first_sentence(F.lit("One. Two."))) == "One" and one(spark, text.first_sentence(F.lit("no end"))) == "no end"
    assert one(spark, text.chunk_word_count(F.array(F.lit("foo"), F.lit("bar baz")))) == 3
    assert one(spark, text.fingerprint(F.lit("a\r\nb"))) == one(spark, text.fingerprint(F.lit("a\nb")))
    assert one(spark, urls.percent_decode(F.lit("a+b%20c"))) == "a+b c" and one(spark, urls.percent_decode(F.lit("%zz"))) == "%zz"


def test_numbers(spark):
    assert one(spark, numbers.half_even(F.lit(0.0625), 3)) == 0.062
    assert one(spark, numbers.first_number(F.lit("about 3,5 s"))) == 3.5
    assert one(spark, numbers.percent(F.lit(0), F.lit(0))) == 0
    assert one(spark, numbers.ratio(F.lit(1), F.lit(0))) is None
    assert one(spark, numbers.annual(F.lit(28.0), F.lit(28))) == 365.0


# --- crawl ---


def site(spark):
    declared = spark.createDataFrame([("/",), *[(f"/{x}",) for x in "abc"], *[(f"/o{i}",) for i in range(8)]], "node string")
    edges = spark.createDataFrame([("/", "/a", True), ("/", "/b", True), ("/", "/c", False), ("/a", "/b", True), ("/a", "/", False)], "src string, dst string, contextual boolean")
    return declared, edges, spark.createDataFrame([("/",)], "node string")


def test_bounded_crawl(spark):
    """A cap leaves pages unvisited and the coverage says so; forbidden pages are known and never visited; declared ones come last."""
    declared, edges, root = site(spark)
    whole = graph.crawl(edges, root, cap=50, declared=declared)
    rows = {r["node"]: (r["depth"], r["found_by"], r["visited"]) for r in whole.collect()}
    assert len(rows) == 12 and rows["/"] == (0, "link", True) and rows["/c"] == (1, "link", True) and rows["/o7"] == (None, "declared", True)
    assert graph.coverage(declared, whole.where("visited"), cap=50).first()["complete"]
    capped = graph.crawl(edges, root, cap=3, declared=declared)
    assert {r["node"] for r in capped.where("visited").collect()} == {"/", "/a", "/b"}
    gate = graph.coverage(declared, capped.where("visited"), cap=3).first()
    assert not gate["complete"] and gate["reason"] == "cap_reached" and gate["unvisited"] == 9
    blocked = spark.createDataFrame([("/a",), ("/c",)], "node string")
    seen = graph.crawl(edges, root, cap=50, blocked=blocked)
    assert {r["node"] for r in seen.where("visited").collect()} == {"/", "/b"} and seen.count() == 4
    assert graph.coverage(seen, seen.where("visited"), blocked).first()["reason"] == "blocked_by_robots"
    fan = spark.createDataFrame([("/", f"/p{i:03d}") for i in range(100)], "src string, dst string")
    assert graph.crawl(fan, root, cap=4).count() == 1 + graph.QUEUE_FACTOR * 4 - 1
    assert graph.crawl(edges, root.where("false"), cap=4).count() == 0


def test_quantiles_of_hot_groups(spark):
    import numpy as np

    r = np.random.default_rng(2)
    rows = [("hot", float(v)) for v in r.integers(0, 40, 500)] + [("cold", 1.0), (None, 2.0), (None, 5.0), ("hot", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    for q in (0.0, 0.25, 0.5, 0.9, 1.0):
        got = {x["g"]: x["q"] for x in table.quantile(df, ["g"], "v", q, "q").collect()}
        assert got == {g: pytest.approx(np.quantile([v for k, v in rows if k == g and v is not None], q)) for g in ("hot", "cold", None)}
    assert table.quantile(df, [], "v", 0.5, "q").first()["q"] == pytest.approx(np.quantile([v for _, v in rows if v is not None], 0.5))
    assert table.quantile(df.where("false"), ["g"], "v", 0.5, "q").count() == 0


def test_rerun_of_a_sink(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    for part in (rows, rows, rows.where("k = 'a'")):
        sinks.write_partitioned(part, str(tmp_path / "p"), "k")
    assert spark.read.json(str(tmp_path / "p")).count() == 2


def test_cited_ids_end_at_their_digits(spark):
    df = spark.createDataFrame([("nodes 35-38 and node 12",)], "t string")
    row = migrate.cited_moves(df, "t", {3: 4, 35: 36, 12: 13}).first()
    assert row["moved"] == [12] and row["ranges"] == ["35-38"]


def test_drift_names_rows_on_one_side(spark):
    a, b = spark.createDataFrame([(1, None), (2, "x")], "id int, v string"), spark.createDataFrame([(2, "x"), (3, None)], "id int, v string")
    assert {(r["id"], r["side"]) for r in rules.drift(a, b, "id", ["v"]).collect()} == {(1, "only_left"), (3, "only_right")}


def test_orphans_and_depth(spark):
    declared, edges, root = site(spark)
    assert graph.orphans(declared, edges, F.lit("/")).count() == 8
    got = {r["node"]: r["depth"] for r in graph.two_phase(edges, root, declared).collect()}
    assert got["/a"] == 1 and got["/"] == 0 and got["/o1"] is None and len(got) == 12
    links = {r["node"]: (r["links"], r["contextual_links"]) for r in graph.in_degree(edges, "contextual").collect()}
    assert links["/b"] == (2, 2) and links["/"] == (1, 0)


def test_incomplete_coverage_refuses(spark):
    declared, edges, root = site(spark)
    visited = graph.click_depth(edges, root)
    gate = graph.coverage(declared, visited, cap=4).first()
    assert not gate["complete"] and gate["unvisited"] == 8 and gate["reason"] == "cap_reached"
    assert one(spark, graph.gated(F.lit(8), F.lit(False))) is None
    blocked = declared.where("node like '/o%'")
    assert graph.coverage(declared, visited, blocked).first()["reason"] == "blocked_by_robots"
    assert graph.coverage(declared, declared).first()["complete"]


HTML = [
    '<link rel="canonical" href="/x"><meta name="robots" content="noindex"><meta property="og:title" content="T">',
    '<link href="/x" rel="canonical">',
    "<LINK HREF='/x' REL='Canonical Next'>",
    "<p>none</p>",
]


def test_markup_in_any_order(spark):
    rows = spark.createDataFrame(list(enumerate(HTML)), "id int, html string")
    got = {r["id"]: r for r in pages.extract(rows, "id").collect()}
    assert [got[i]["canonical"] for i in range(4)] == ["/x", "/x", "/x", None]
    assert got[0]["robots"] == "noindex" and got[0]["og"] == {"og:title": "T"}


def test_json_ld(spark):
    good = '<script type="application/ld+json">{"@type":"Product"}</script><script type="application/ld+json">{"@graph":[{"@type":"Organization"},{"@type":["WebSite"]}]}</script>'
    bad = '<script type="application/ld+json">{oops</script>'
    got = pages.extract(spark.createDataFrame([(1, good), (2, bad), (3, None)], "id int, html string"), "id")
    rows = {r["id"]: r for r in got.collect()}
    assert sorted(rows[1]["types"]) == ["Organization", "Product", "WebSite"] and not rows[1]["json_ld_errors"]
    assert not rows[2]["types"] and len(rows[2]["json_ld_errors"]) == 1 and rows[3]["title"] is None
    assert values(pages.type_distribution(got)) == ["Organization", "Product", "WebSite"]


def test_words_leave_out_title_and_h1(spark):
    got = pages.signals("<title>a b</title><h1>c</h1><nav><a href='/n'>menu</a></nav><p>foo<b>bar</b></p><a href='/t'>x</a><script>no</script>")
    assert got["words"] == 4 and [x["contextual"] for x in got["links"]] == [False, True]


def test_indexable_is_tri_state(spark):
    f = lambda status, robots, canonical: one(spark, pages.indexable(F.lit(status), F.lit(robots).cast("string"), F.lit(canonical).cast("string"), F.lit("http://a.com/x")))
    assert f(200, None, None) is True and f(200, "noindex", None) is False and f(200, None, "/y") is False and f(200, None, "/x/") is True and f(500, None, None) is None


def test_sitemaps(spark):
    robots = spark.createDataFrame([("a.com", "User-agent: *\nDisallow: /no\nSitemap: https://a.com/i.xml"), ("b.com", "")], "host string, body string")
    files = spark.createDataFrame([("https://a.com/i.xml", "<sitemapindex><loc>https://a.com/s.xml</loc></sitemapindex>"), ("https://a.com/s.xml", "<urlset><loc>https://a.com/x/</loc><loc>https://other.com/</loc><loc>https://a.com/x</loc></urlset>")], "sitemap string, body string")
    assert [tuple(r) for r in sitemaps.declared_urls(robots, files).collect()] == [("a.com", "https://a.com/x")]
    robots = spark.createDataFrame([("a.com", "User-agent: *\nDisallow: /no")], "host string, body string")
    assert not sitemaps.judge_robots(spark.createDataFrame([("a.com", "https://a.com/no/x")], "host string, url string"), robots).first()["allowed"]


def test_declared_urls(spark):
    schema = "url string, status int, redirects array<string>, canonical string, hreflang array<struct<lang: string, href: string>>, in_sitemap boolean"
    red = spark.createDataFrame([("/a", 200, [], "/old", [("fr", "/old")], True), ("/old", 301, ["/new"], None, [], False)], schema)
    got = {r["rule"]: r for r in rules.declared_urls(red).collect()}
    assert got["U1"]["verdict"] == got["U2"]["verdict"] == "FAIL" and got["U1"]["examples"] == ["/old"] and got["U3"]["verdict"] == "PASS"
    unseen = spark.createDataFrame([("/a", 200, [], "/never", [], False)], schema)
    got = {r["rule"]: r for r in rules.declared_urls(unseen).collect()}
    assert got["U1"]["verdict"] == "SANS_OBJET" and got["U1"]["unseen"] == 1 and got["U2"]["subjects"] == 0
    assert {r["verdict"] for r in rules.declared_urls(red.where("false")).collect()} == {"SANS_OBJET"}


# --- redirects ---


def kinds(findings):
    return {(f["kind"], f["severity"]) for f in findings}


def blocking(findings):
    return {f["kind"] for f in findings if f["severity"] == redirects.BLOCKING}


def judge(spark, rows):
    """Findings of (vehicle, source, target, code) rows, in their order."""
    given = [(i, v, s, t, c, t is not None, None, None, "full_uri" if v == "single-redirects-joker" else None) for i, (v, s, t, c) in enumerate(rows)]
    df = spark.createDataFrame(given, "n int, vehicle string, source string, target string, code int, readable boolean, many boolean, keeps boolean, field string")
    return [r["findings"] for r in redirects.findings(df).orderBy("n").collect()]


FILES = [
    ("/blog/* https://b.com/:splat 301", set(), None), ("/blog/* https://b.com/$1 301", {"jeton-litteral"}, "https://b.com/:splat"), ("/blog/* https://b.com/ 301", {"chemin-perdu"}, "https://b.com/:splat"), ("/m/:t /media/:t 301", set(), None),
    ("/m/:t /media/ 301", {"chemin-perdu"}, "/media/:t"), ("/p https://b.com/:splat 301", {"reference-hors-joker"}, None), ("/blog/* https://b.com/${1} 301", {"jeton-litteral"}, "https://b.com/:splat"), ("/p https://b.com/$1 301", {"jeton-litteral"}, None),
    ("/a/:x/:y /b 301", {"chemin-perdu"}, "/b/:x"),
]


def test_redirects_file(spark):
    lines = "\n".join(line for line, *_ in FILES)
    rows = spark.createDataFrame([("f", lines)], "name string, text string")
    found = [r["findings"] for r in redirects.judged(rows).orderBy(F.expr("int(substring(id, 6))")).collect()]
    assert [blocking(f) for f in found] == [want for _, want, _ in FILES]
    assert [next((x["suggestion"] for x in f if x["severity"] == redirects.BLOCKING), None) for f in found] == [new for *_, new in FILES]
    mended = "\n".join(f"{line.split()[0]} {new} 301" for line, _, new in FILES if new)
    again = redirects.judged(spark.createDataFrame([("f", mended)], "name string, text string")).collect()
    assert len(again) == 5 and not any(r["blocking"] for r in again)


def test_redirects_file_warnings(spark):
    rows = spark.createDataFrame([("f", "# note\n\n  /a /b\n/a /b 301 Country=us\n/a /b 999\n/x/*/* /y/:splat 301\n/x /y/:who 301")], "name string, text string")
    got = {r["id"]: kinds(r["findings"]) for r in redirects.judged(rows).collect()}
    w = redirects.WARNING
    assert got == {"line 3": {("code-non-permanent", w)}, "line 4": {("ligne-ignoree", w)}, "line 5": {("ligne-ignoree", w)}, "line 6": {("ligne-ignoree", w)}, "line 7": {("reference-hors-joker", w)}}
    assert redirects.rules_of("# note\n\n  \n") == []


PATTERNS = [
    ("example.com/*", "https://w.com/$1", 301, set(), set(), None), ("example.com/*", "https://w.com/", 301, {"chemin-perdu"}, set(), "https://w.com/$1"), ("*example.com/*", "https://w.com/$1", 301, {"chemin-perdu"}, set(), "https://w.com/$2"),
    ("example.com/*", "https://w.com/$2", 301, {"reference-hors-joker", "chemin-perdu"}, set(), "https://w.com/$2/$1"), ("example.com/*", "https://w.com/:splat", 301, {"jeton-litteral"}, set(), "https://w.com/$1"),
    ("example.com/*", "https://w.com/${1}", 301, set(), {"forme-non-documentee"}, None), ("example.com/*", "https://w.com/$1", 302, set(), {"code-non-permanent"}, None), ("example.com/*", "https://w.com/p\\$1", 301, {"chemin-perdu"}, set(), "https://w.com/p\\$1/$1"),
    # The first wildcard of the path is put in, a rank of 0 is no citation, and without one in the path nothing is suggested.
    ("*example.com/a/*/b/*", "https://w.com/$1", 301, {"chemin-perdu"}, set(), "https://w.com/$2"), ("*example.com/a/*/b/*", "https://w.com/$3", 301, set(), set(), None), ("example.com/*", "https://w.com/$0", 301, {"chemin-perdu"}, set(), "https://w.com/$0/$1"),
    ("*.example.com/", "https://w.com/:splat", 301, {"jeton-litteral"}, set(), None), ("http*://example.com/x/*", "https://$1.w.com/$1", 301, {"chemin-perdu"}, set(), "https://$1.w.com/$2"), ("example.com*", "https://w.com/$1", 301, set(), set(), None),
    ("*example.com/*", "https://w.com/$1/$7", 301, {"reference-hors-joker", "chemin-perdu"}, set(), "https://w.com/$2/$7"),
]


def test_page_rules(spark):
    found = judge(spark, [("page-rules", p, t, c) for p, t, c, *_ in PATTERNS])
    for (_, _, _, want, warned, new), f in zip(PATTERNS, found, strict=True):
        assert blocking(f) == want and {k for k, s in kinds(f) if s == redirects.WARNING} == warned
        assert [x["suggestion"] for x in f if x["suggestion"]] == ([new] if new else [])


def wildcard(field, pattern, new):
    return {"expression": f'wildcard_replace({field}, r"{pattern}", r"{new}")'}


URI, PATH, HOST = "http.request.full_uri", "http.request.uri.path", 'http.host eq "old.example.com"'
SINGLES = [
    (f'{URI} wildcard r"https://www.e.com/*"', wildcard(URI, "https://www.e.com/*", "https://e.com/${1}"), set()),
    (f'{URI} wildcard r"http*://www.e.com/*"', wildcard(URI, "http*://www.e.com/*", "https://e.com/${1}"), {"chemin-perdu"}),
    (f'{PATH} wildcard "/blog/*"', {"value": "https://e.com/$1"}, {"jeton-litteral"}), (HOST, {"value": "https://e.com/"}, {"chemin-perdu"}), (f'{PATH} eq "/c.html"', {"value": "https://e.com/c"}, set()),
    (f'{PATH} wildcard "/app/*"', wildcard(URI, "/app/*", "/apps/${1}"), {"motif-jamais-apparie"}), (HOST, {"expression": f'concat("https://n.com", {PATH})'}, set()), (HOST, {"expression": 'concat("https://n.com", "/x")'}, {"chemin-perdu"}),
    (f'{URI} wildcard r"https://e.com/*"', wildcard(URI, "https://e.com/\\*/*", "https://e.com/${1}"), set()),
]


def test_single_redirects(spark):
    listed = [{"id": str(i), "action": "redirect", "expression": c, "action_parameters": {"from_value": {"target_url": t, "status_code": 301}}} for i, (c, t, _) in enumerate(SINGLES)]
    listed += [{"id": "off", "enabled": False, **{k: v for k, v in listed[3].items() if k != "id"}}, {"id": "skip", "action": "skip"}]
    rows = spark.createDataFrame([("s", json.dumps({"result": {"rules": listed}}))], "name string, text string")
    got = {r["id"]: blocking(r["findings"]) for r in redirects.judged(rows).collect()}
    assert got == {str(i): want for i, (*_, want) in enumerate(SINGLES)}


def test_exports_in_spark(spark):
    bulk = lambda **r: json.dumps({"result": [{"id": "b", "redirect": {"source_url": "e.com/a/", "target_url": "https://e.com/b/", "status_code": 301, **r}}]})
    page = json.dumps({"result": [{"id": "p", "status": "active", "targets": [{"target": "url", "constraint": {"value": "e.com/*"}}], "actions": [{"id": "forwarding_url", "value": {"url": "https://w.com/", "status_code": 301}}]}]})
    texts = {"green": bulk(subpath_matching=True), "red": bulk(subpath_matching=True, preserve_path_suffix=False), "exact": bulk(subpath_matching=False, preserve_path_suffix=False), "page": page, "off": page.replace("active", "disabled")}
    got = redirects.judged(spark.createDataFrame(list(texts.items()), "name string, text string"))
    assert {r["name"]: r["blocking"] for r in got.collect()} == {"green": False, "red": True, "exact": False, "page": True}
    waivers = spark.createDataFrame([("p",), ("none",)], "id string")
    assert {r["name"] for r in redirects.waived(got, waivers).where("waived").collect()} == {"page"}
    assert values(redirects.unused_waivers(got, waivers)) == ["none"]
    fold = rules.fold_compliance(redirects.waived(got, waivers).withColumn("judged", F.lit(True)).where("name <> 'red'"), waivers).first()
    assert fold["verdict"] == "PASS" and fold["waived"] == 1


def test_probes(spark):
    rows = [("kept", 301, "https://n.com/w/x", "w/x"), ("lost", 301, "/", "w/x"), ("literal", 301, "/n/$1", "w/x"), ("coded", 301, "/n/$%7B1%7D", "w/x"), ("temporary", 302, "/n/w/x", "w/x"), ("plain", 200, None, "w/x"), ("down", 0, None, "w/x")]
    got = {r["url"]: r for r in redirects.judge_probes(spark.createDataFrame(rows, "url string, code int, location string, witness string")).collect()}
    assert [f["kind"] for f in got["kept"]["findings"]] == [] and blocking(got["lost"]["findings"]) == {"chemin-perdu"}
    assert blocking(got["literal"]["findings"]) == blocking(got["coded"]["findings"]) == {"jeton-litteral"}
    assert kinds(got["temporary"]["findings"]) == {("code-non-permanent", redirects.WARNING)} and kinds(got["plain"]["findings"]) == {("sans-redirection", redirects.WARNING)}
    assert not got["down"]["judged"]
    down = spark.createDataFrame([("x", False, False)], "id string, judged boolean, blocking boolean")
    assert rules.fold_compliance(down).first()["verdict"] == "SKIP"


# --- actions ---


def action(**more):
    base = {c: "x" for c in scoring.REQUIRED}
    base |= {"id": "A1", "volet": "ETAT", "noeuds_couverts": "43 19", "gain": "4", "confiance": "4", "effort": "2", "horizon": "quick-win", "axe_execution": "IA", "regime_automatisation": "bout-en-bout", "axe_cout": "GRATUIT", "cout_eur": "0", "dependance_de": None}
    return base | more


def frame(spark, *rows):
    columns = [*scoring.REQUIRED, "dependance_de"]
    return spark.createDataFrame([[r[c] for c in columns] for r in rows], ", ".join(f"{c} string" for c in columns))


@pytest.mark.parametrize(("change", "word"), [({"gain": "6"}, "gain"), ({"horizon": "quick win"}, "horizon"), ({"axe_cout": "?"}, "axe_cout"), ({"critere_acceptation": ""}, "missing"), ({"dependance_de": "Z"}, "dependency"), ({"noeuds_couverts": "none"}, "node")])
def test_invalid_actions(spark, change, word):
    found = scoring.violations(frame(spark, action(**change))).first()["violations"]
    assert len(found) == 1 and word in found[0]
    with pytest.raises(ValueError, match="refused"):
        scoring.refuse_invalid(frame(spark, action(**change)))


def test_scores_and_csv(spark, tmp_path):
    rows = frame(spark, action(id="A2", gain="5", confiance="3", effort="4", noeuds_couverts="74, 25 66", dependance_de="A1"), action())
    assert not any(r["violations"] for r in scoring.violations(rows).collect())
    sinks.write_actions(rows, str(tmp_path / "a"))
    back = documents.read_actions(spark, str(tmp_path / "a"))
    assert [(r["id"], r["score"]) for r in back.collect()] == [("A1", "8.0"), ("A2", "3.75")] and back.where("id = 'A2'").first()["node_ids"] == [74, 25, 66]
    with pytest.raises(ValueError, match="repeated"):
        sinks.write_actions(frame(spark, action(), action()), str(tmp_path / "b"))


@pytest.mark.parametrize("d", [",", ";", "\t", "|"])
def test_csv_dialects(spark, tmp_path, d):
    (tmp_path / "a.csv").write_text(f"﻿id{d}action{d}gain\nA1{d}x{d}4\n", encoding="utf-8")
    row = documents.read_actions(spark, str(tmp_path / "a.csv")).first()
    assert (row["id"], row["gain"]) == ("A1", "4")


def test_csv_without_known_column(spark, tmp_path):
    (tmp_path / "a.csv").write_text("foo,bar\n1,2\n")
    with pytest.raises(ValueError, match="known column"):
        documents.read_actions(spark, str(tmp_path / "a.csv"))


def test_dependencies_are_lifted(spark):
    rows = spark.createDataFrame([("A", 8.0), ("B", 1.0), ("C", 1.5), ("D", 3.0)], "id string, score double")
    deps = spark.createDataFrame([("A", "B"), ("B", "C")], "src string, dst string")
    assert {r["id"]: r["band"] for r in scoring.lifted(rows, deps).collect()} == {"A": "do", "B": "do", "C": "do", "D": "watch"}


def test_attachment(spark):
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    none = ids.where("false")
    assert scoring.attachment(ids, ids.where("id = 'a'"), "id").first()["rate"] == 0.5
    assert not scoring.attachment(ids, none, "id").first()["ok"] and scoring.attachment(none, none, "id").first()["ok"]
    named = scoring.named_nodes(spark.createDataFrame([("a", [2, 9, 1])], "id string, node_ids array<int>"), spark.createDataFrame([(1, "x"), (2, "y")], "node int, name string"))
    assert named.first()["nodes"] == ["y", "x"]


# --- snapshots, rules, migration ---

SCHEMA = {"type": "object", "required": ["v", "n"], "additionalProperties": False, "properties": {"v": {"const": "1"}, "n": {"type": "array", "minItems": 2, "items": {"$ref": "#/$defs/node"}}, "x": {"type": ["string", "null"]}}, "$defs": {"node": {"type": "integer", "minimum": 1, "maximum": 89}}}


CONTRACT = [
    ('{"v": "1", "n": [1, 2]}', []), ('{"v": "2", "n": [1, 2]}', ["$.v: is not '1'"]), ('{"v": "1", "n": [true, 2]}', ["$.n[0]: is not of type 'integer'"]), ('{"v": "1", "n": [1]}', ["$.n: has fewer than 2 items"]),
    ('{"v": "1", "n": [1, 90, 0, 1.5]}', ["$.n[1]: is above 89", "$.n[2]: is below 1", "$.n[3]: is not of type 'integer'"]), ('{"v": "1"}', ["$.n: is missing"]), ('{"v": "1", "n": [1, 2], "y": 0}', ["$.y: is unknown"]),
    ('{"v": "1", "n": [1, 2], "x": null}', []), ('{"v": "1", "n": [1, 2], "x": 3}', ["$.x: is not of type ['string', 'null']"]), ("[1]", ["$: is not of type 'object'"]), ("{", ["$: is not readable JSON"]), (None, ["$: is not readable JSON"]),
    ('{"v": "1", "n": [1, 2], "k": "b"}', []), ('{"v": "1", "n": [1, 2], "k": true}', []), ('{"v": "1", "n": [1, 2], "k": 1}', ["$.k: is not one of ['a', 'b', True, None, 2]"]), ('{"v": "1", "n": [1, 2], "k": 2.0}', []), ('{"v": "1", "n": [12345678901234567890, 2]}', ["$.n[0]: is above 89"]),
]


def test_contract(spark):
    schema = SCHEMA | {"properties": SCHEMA["properties"] | {"k": {"enum": ["a", "b", True, None, 2]}}}
    rows = spark.createDataFrame([(i, t, "clash") for i, (t, _) in enumerate(CONTRACT)], "i int, body string, value string")
    got = {r["i"]: r["violations"] for r in snapshot.contract_violations(rows, schema).collect()}
    assert got == {i: want for i, (_, want) in enumerate(CONTRACT)}
    # A contract that holds itself is judged to any depth.
    nested = spark.createDataFrame([(1, "[[[]], []]"), (2, '[[], [[1, []]]]')], "i int, body string")
    got = {r["i"]: r["violations"] for r in snapshot.contract_violations(nested, {"$ref": "#/$defs/a", "$defs": {"a": {"type": "array", "items": {"$ref": "#/$defs/a"}}}}).collect()}
    assert got == {1: [], 2: ["$[1][0][0]: is not of type 'array'"]}


def test_tagged_metrics(spark):
    body = '{"a": {"cle": "x", "preuve": "T1", "more": [{"cle": "y", "preuve": "T2"}, {"cle": "z"}]}, "cle": "top"}'
    rows = spark.createDataFrame([(1, body), (2, "{"), (3, "[]")], "id int, body string")
    assert sorted(map(tuple, snapshot.tagged_metrics(rows).collect())) == [(1, "$.a", "x", "T1"), (1, "$.a.more[0]", "y", "T2")]


def test_snapshot_is_written_whole_or_not(spark, tmp_path):
    good, bad = json.dumps({"v": "1", "n": [1, 2]}), "{"
    sinks.write_snapshot(spark.createDataFrame([(good,)], "body string"), str(tmp_path / "s"), SCHEMA)
    with pytest.raises(ValueError, match="readable"):
        sinks.write_snapshot(spark.createDataFrame([(good,), (bad,)], "body string"), str(tmp_path / "t"), SCHEMA)
    assert not (tmp_path / "t").exists()


def test_sheet_states(spark):
    rows = spark.createDataFrame([(True, "conforme", "SD", None, True, False), (True, "conforme", "SD", None, True, True), (False, None, "PY", None, False, False), (False, None, "SD", "hors-perimetre", False, False), (False, None, "SD", None, False, False)], "found boolean, verdict string, status string, previous string, needs boolean, has boolean")
    state, verdict = snapshot.sheet_state(*[F.col(c) for c in ("found", "verdict", "status", "previous", "needs", "has")])
    assert [tuple(r) for r in rows.select(state, verdict).collect()] == [("fait", "non-mesure"), ("fait", "conforme"), ("hors-perimetre", "sans-objet"), ("hors-perimetre", "sans-objet"), ("a-faire", None)]


def test_measurement_plan(spark):
    fields = [*rules.PLAN_FIELDS, "dispersion", "verdict", "reserve"]
    full = ["f", "fr", "s", "3", "1-2", "conforme", "Non reproductible"]
    cases = [full, ["", "", "", "", "", "conforme", "non reproductible"], [*full[:3], "1", *full[4:]], [*full[:4], "-", *full[5:]], ["", "", "", "", "", "non-mesure", "non reproductible"], ["", "", "", "", "", "conforme", "x"]]
    got = rules.measurement_plan(spark.createDataFrame(cases, ", ".join(f"{c} string" for c in fields)))
    assert [len(r["violations"]) for r in got.collect()] == [0, 1, 1, 1, 0, 0]


def test_directive_file(spark):
    rows = [("llms.txt", "conforme", "llms.txt answers"), ("llms.txt", "conforme", "llms.txt lists 12 URLs"), ("llms.txt", "conforme", "llms.txt absent"), ("llms.txt", "non-mesure", "llms.txt?"), ("crawl", "conforme", "llms.txt")]
    got = rules.directive_file_read(spark.createDataFrame(rows, "source_requise string, verdict string, constat string"))
    assert values(got, "ok") == [False, True, True, True, True]


def test_connector_metrics(spark):
    rows = [("T1", "connecteur, lu le 2026-01-05, période 2025-01-01 / 2025-12-31"), ("T2", "connecteur, lu le 2026-01-05, période 2025-01-01 / 2025-12-31"), ("T1", "connecteur, lu le 2026-01-05"), ("T2", "export")]
    got = rules.connector_metrics(spark.createDataFrame(rows, "preuve string, source string"))
    assert [len(v) for v in values(got, "violations")] == [0, 1, 1, 0]


def test_field_metrics(spark):
    ok = json.dumps({"record": {"key": {"url": "u"}, "metrics": {"lcp": {"histogram": [{"start": 0, "end": 2500, "density": 0.7}, {"start": 2500, "density": 0.2}, {"density": 0.1}], "percentiles": {"p75": 2100}}, "cls": {"histogram": [], "percentiles": {"p75": "0.05"}}}}})
    got = {r["metric"]: r for r in documents.field_metrics(spark.createDataFrame([(ok,), ('{"error": 404}',)], "body string")).collect()}
    assert got["lcp"]["p75"] == "2100" and got["lcp"]["poor"] == 0.1 and got["cls"]["p75_number"] == 0.05 and len(got) == 2


def test_sheets(spark):
    text_ = "---\n# note\nid: 3\nverdict: null\n---\n## Constat\n<!-- x -->\nseen\n\n## Preuves\nnone\n"
    assert one(spark, documents.front_matter(F.lit(text_))) == {"id": "3", "verdict": "null"}
    assert one(spark, documents.section(F.lit(text_), "Constat")) == "seen" and one(spark, documents.section(F.lit(text_), "Interpretation")) is None
    with pytest.raises(Exception, match="front-matter"):
        one(spark, documents.front_matter(F.lit("---\nbroken\n---\n")))
    grid = spark.createDataFrame([("## 1. Idea — x\n| 1 | a | b |\n## 2. Base — y\n| 2 | c | d |\n",)], "text string")
    assert [(r["section"], r["cells"]) for r in documents.table_rows(grid, "text", 3).orderBy("line").collect()] == [("Idea", ["1", "a", "b"]), ("Base", ["2", "c", "d"])]


def test_migration(spark):
    evolutions = [({58: 59, 59: 60}, [], [58]), ({60: 61}, [40], [60])]
    ids = spark.createDataFrame([(i,) for i in (1, 40, 58, 59)], "id int")
    assert {r["id"]: r["new_id"] for r in migrate.compose(ids, [e[:2] for e in evolutions]).collect()} == {1: 1, 58: 59, 59: 61}
    assert migrate.new_ids(evolutions) == [58, 60] and migrate.retired_in_origin([({39: 40}, []), ({}, [40])]) == [39]
    arcs = spark.createDataFrame([("a", "b"), ("b", "c")], "de string, vers string")
    assert {r["version"]: r["hops"] for r in migrate.chains(arcs, "a").collect()} == {"a": 0, "b": 1, "c": 2} and migrate.chains(arcs, "z").count() == 1
    sheets = spark.createDataFrame([("1", True), ("x", False), ("40", True), ("58", False)], "id string, has_work boolean")
    mapping = spark.createDataFrame([(1, 1), (58, 1)], "id int, new_id int")
    assert {r["reason"] for r in migrate.refusals(sheets, mapping, spark.createDataFrame([(1,)], "id int"), True).collect()} == {"unreadable_id", "retired_or_orphan_with_work", "collision"}
    assert migrate.refusals(sheets, mapping, mapping, False).first()["reason"] == "unknown_version"


def test_verified_rewrite(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert sinks.write_verified(rows.withColumn("v", F.lit("z")), str(tmp_path / "a"), rows, ["v"]).count() == 2
    with pytest.raises(ValueError, match="lost"):
        sinks.write_verified(rows.where("id = 1"), str(tmp_path / "b"), rows, [])
    assert sinks.next_version(["20260101a"], "20260101", "d", {"20260101a": "d"}) is None and sinks.next_version(["20260101a"], "20260101", "e", {"20260101a": "d"}) == "20260101b"


def test_folds(spark):
    rows = spark.createDataFrame([("a", "PASS"), ("a", "FAIL"), ("b", "PASS"), ("c", None)], "rule string, verdict string")
    assert {r["rule"]: r["verdict"] for r in rules.fold(rows, ["rule"]).collect()} == {"a": "FAIL", "b": "PASS", "c": "SANS_OBJET"}
    checks = spark.createDataFrame([("x", True), ("y", False)], "name string, ok boolean")
    assert tuple(rules.envelope(checks).first()) == ("FAIL", 2, 1, ["y"])
    assert rules.contiguous(spark.createDataFrame([(1,), (2,)], "id int")).first()["ok"] and not rules.contiguous(spark.createDataFrame([(1,), (3,)], "id int")).first()["ok"]


def test_tables(spark):
    rows = spark.createDataFrame([("Été", "3,5", "b"), ("hiver", "10", "a"), ("x", None, "a")], "name string, n string, g string")
    assert values(table.search(rows, ["name"], "ETE")) == ["Été"]
    assert values(table.sort(rows, "n", True, True)) == ["hiver", "Été", "x"] and values(table.sort(rows, "n", True, False)) == ["Été", "hiver", "x"]
    assert table.filter_values(rows, "g").count() == 0
    series = spark.createDataFrame([(i, 10.0 + i % 2) for i in range(8)] + [(8, 90.0)], "t int, v double")
    assert values(table.breaks(series, "t", "v").where("is_break")) == [8]


def test_stream(spark, small, tmp_path):
    schema = spark.read.parquet(f"{small}/events.parquet")
    spark.read.parquet(f"{small}/events.parquet").write.parquet(str(tmp_path / "in"))
    raw = spark.readStream.schema(schema.schema).parquet(str(tmp_path / "in"))
    hits = raw.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("agent"), F.lit(200).alias("status"))
    q = stream.windowed_breakdown(hits, "ts", "agent", "status").writeStream.outputMode("complete").format("memory").queryName("agents").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(hits) from agents").first()[0] == schema.count()


def test_references_left_as_written(spark, tmp_path):
    """page_title_h1 reads "&amp;" alone, as its SQL; the reader itself reads all, and scripts stay as they are either way."""
    duckdb = pytest.importorskip("duckdb")
    from tidewrack.plans import queries

    heads = ["a &amp; b &amp", "x = &quot;1&quot;", "caf&eacute; &#233; & co &am", "", "&amp;amp;"]
    rows = [(i, f'<html><head><title>{t}</title></head><body><h1>{t}</h1><a href="/x?a=1&amp;b=2">l</a></body></html>') for i, t in enumerate(heads)] + [(9, "<p>none</p>")]
    spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = sorted(tuple(r) for r in queries.QUERIES["page_title_h1"](spark, str(tmp_path)).collect())
    assert got == sorted(c.execute(queries.ORACLES["page_title_h1"]).fetchall())
    assert pages.signals(rows[1][1])["title"] == 'x = "1"'
    block = '{"@type": "A&B", "u": "?a&amp;b"}'
    html = f'<!-- & --><script type="application/ld+json">{block}</script><h1>R&D &lt;</h1>'
    assert [pages.signals(html, loose)["json_ld"] for loose in (False, True)] == [[block]] * 2
    assert [pages.signals(html, loose)["h1"] for loose in (False, True)] == ["R&D <", "R&D &lt;"]
