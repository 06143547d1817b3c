"""Queries over a site: pages, sitemaps, redirects, crawls and logs. Suppliers are its pages, parts its rules, orders its runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewrack.functions import text, urls
from tidewrack.operators import graph, logs, redirects, rules, table
from tidewrack.plans.registry import query, read
from tidewrack.sources import pages, sitemaps
from tidewrack.streaming import logs as stream

# --- sitemaps and robots ---------------------------------------------------------------------------------------

URL = "'https://h' || s_nationkey || '.com/p/' || s_suppkey"


def _site_files(spark, sf_dir):
    """Robots and sitemap files: hosts of even numbers name an index, the others have sitemap.xml; an index has a file for each thousand of balance."""
    s = read(spark, sf_dir, "supplier").withColumn("host", F.concat(F.lit("h"), "s_nationkey", F.lit(".com")))
    even = F.col("s_nationkey") % 2 == 0
    robots = s.groupBy("host", "s_nationkey").agg(F.count("*").alias("n")).select("host", F.when(even, F.concat(F.lit("User-agent: *\nDisallow: /p/1\nSitemap: https://"), "host", F.lit("/index.xml"))).otherwise("").alias("body"))
    part = F.concat(F.lit("https://"), "host", F.when(even, F.concat(F.lit("/s"), F.floor(F.col("s_acctbal") / 1000).cast("string"), F.lit(".xml"))).otherwise("/sitemap.xml"))
    loc = F.concat(F.lit("<url><loc> "), F.lit("https://"), "host", F.lit("/p/"), "s_suppkey", F.lit("/ </loc></url>"))
    leaves = s.groupBy("host", part.alias("sitemap")).agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(loc), ""), F.lit("<url><loc>https://other.com/x</loc></url></urlset>")).alias("body"))
    index = leaves.where(F.col("sitemap").rlike(r"/s-?\d+\.xml$")).groupBy("host").agg(F.concat(F.lit("<sitemapindex>"), F.array_join(F.collect_list(F.concat(F.lit("<sitemap><loc>"), "sitemap", F.lit("</loc></sitemap>"))), ""), F.lit("</sitemapindex>")).alias("body"))
    files = leaves.select("sitemap", "body").unionByName(index.select(F.concat(F.lit("https://"), "host", F.lit("/index.xml")).alias("sitemap"), "body"))
    return robots, files


@query(f"SELECT 'h' || s_nationkey || '.com' AS host, {URL} AS url FROM supplier")
def sitemap_urls(spark, sf_dir):
    return sitemaps.declared_urls(*_site_files(spark, sf_dir))


@query("""
WITH f AS (SELECT s_nationkey AS k, count(DISTINCT CASE WHEN s_nationkey % 2 = 0 THEN floor(s_acctbal / 1000) ELSE 0 END) + (s_nationkey % 2 = 0)::INT AS files FROM supplier GROUP BY 1)
SELECT 'h' || k || '.com' AS host, files, greatest(files - 3, 0) AS unread, files <= 3 AS complete FROM f""")
def sitemap_unread(spark, sf_dir):
    return sitemaps.unread(*_site_files(spark, sf_dir), most=3)


@query(f"SELECT {URL} AS url, NOT (s_nationkey % 2 = 0 AND starts_with(CAST(s_suppkey AS VARCHAR), '1')) AS allowed FROM supplier")
def robots_allowed(spark, sf_dir):
    robots, _ = _site_files(spark, sf_dir)
    s = read(spark, sf_dir, "supplier").select(F.concat(F.lit("h"), "s_nationkey", F.lit(".com")).alias("host"), F.concat(F.lit("https://h"), "s_nationkey", F.lit(".com/p/"), "s_suppkey").alias("url"))
    return sitemaps.judge_robots(s, robots).select("url", "allowed")


# --- pages -----------------------------------------------------------------------------------------------------


def _crawled(spark, sf_dir):
    """HTML of a page for each supplier: heads, links and JSON-LD of several kinds."""
    k = F.col("s_suppkey")
    head = F.concat(
        F.lit("<html><head><title>"), F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("Page "), (k % 40).cast("string"))), F.lit("</title>"),
        F.when(k % 3 == 0, F.concat(F.lit('<link href="/p/'), k, F.lit('/" rel="canonical">'))).when(k % 3 == 1, "<link rel='Canonical' href='/p/0'>").otherwise(""),
        F.when(k % 5 == 0, '<meta NAME="robots" content="NOINDEX, follow">').otherwise(""),
        F.when(k % 4 == 0, '<meta property="og:title" content="t">').otherwise(""), F.when(k % 4 == 1, "<link rel=alternate hreflang=FR href=/fr><link rel=alternate hreflang=de href=/de>").otherwise(""),
        F.when(k % 6 == 0, '<script type="application/ld+json">{"@type": "Product"}</script>').when(k % 6 == 1, '<script type="application/ld+json">{"@graph": [{"@type": ["Organization", "Brand"]}, {"@type": "WebSite"}]}</script>').when(k % 6 == 2, '<script type="application/ld+json">{broken</script>').otherwise(""), F.lit("</head><body>"),
    )
    body = F.concat(F.lit("<nav><a href='/'>home</a></nav><h1>"), F.when(k % 9 == 0, "").otherwise("Head"), F.lit("</h1><p>"), F.repeat(F.lit("word "), (k % 500).cast("int")), F.lit("<a href='/p/1'>x</a></p></body></html>"))
    s = read(spark, sf_dir, "supplier").select(k.alias("id"), F.concat(F.lit("https://a.com/p/"), k).alias("url"), F.concat(head, body).alias("html"), F.when(k % 11 == 0, 500).when(k % 13 == 0, 0).otherwise(200).alias("status"), (k % 6).cast("int").alias("depth"), (k % 2 == 0).alias("in_sitemap"))
    return s


SIGNALS = """
SELECT s_suppkey AS k, CASE WHEN s_suppkey % 11 = 0 THEN 500 WHEN s_suppkey % 13 = 0 THEN 0 ELSE 200 END AS status, s_suppkey % 5 = 0 AS noindex,
  CASE s_suppkey % 3 WHEN 0 THEN s_suppkey WHEN 1 THEN 0 END AS canonical, s_suppkey % 500 + 2 AS words FROM supplier"""


@query(f"""
SELECT k AS id, CASE WHEN k % 7 <> 0 THEN 'Page ' || k % 40 ELSE '' END AS title, CASE WHEN k % 9 = 0 THEN '' ELSE 'Head' END AS h1, CASE k % 3 WHEN 0 THEN '/p/' || k || '/' WHEN 1 THEN '/p/0' END AS canonical,
  CASE WHEN noindex THEN 'noindex, follow' END AS robots, CASE WHEN k % 4 = 1 THEN 'fr,de' ELSE '' END AS langs, CASE WHEN k % 4 = 0 THEN 't' END AS og_title, CAST(words AS INT) AS words,
  CASE k % 6 WHEN 0 THEN 'Product' WHEN 1 THEN 'Organization,Brand,WebSite' ELSE '' END AS types, (k % 6 = 2)::INT AS errors, '0,1' AS contextual FROM ({SIGNALS})""")
def page_signals(spark, sf_dir):
    found = pages.extract(_crawled(spark, sf_dir), "id")
    return found.select("id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("h1", F.lit("")).alias("h1"), "canonical", "robots", F.array_join(F.transform("hreflang", lambda h: h["lang"]), ",").alias("langs"), F.col("og")["og:title"].alias("og_title"), "words", F.array_join("types", ",").alias("types"), F.size("json_ld_errors").alias("errors"), F.array_join(F.transform("links", lambda x: x["contextual"].cast("int").cast("string")), ",").alias("contextual"))


@query(f"""
SELECT k AS id, CASE WHEN status = 200 THEN NOT noindex AND (canonical IS NULL OR canonical = k) END AS indexable FROM ({SIGNALS})""")
def indexable_pages(spark, sf_dir):
    rows = _crawled(spark, sf_dir)
    found = pages.extract(rows, "id").join(rows.select("id", "url", "status"), "id")
    return found.select("id", pages.indexable(F.col("status"), F.col("robots"), F.col("canonical"), F.col("url")).alias("indexable"))


@query(f"""
WITH s AS ({SIGNALS}), i AS (SELECT *, CASE WHEN status = 200 THEN NOT noindex AND (canonical IS NULL OR canonical = k) END AS indexable FROM s)
SELECT count(*) AS pages, count(*) FILTER (status >= 400) AS errors, count(*) FILTER (status = 0) AS unreachable, count(*) FILTER (status = 200) AS ok, count(*) FILTER (indexable) AS indexable, count(*) FILTER (NOT indexable) AS not_indexable,
  count(*) FILTER (indexable IS NULL) AS indexable_not_measured, count(*) FILTER (k % 7 = 0) AS without_title, count(*) FILTER (k % 9 = 0) AS without_h1, count(*) FILTER (k % 3 <> 2) AS with_canonical, count(*) FILTER (k % 4 = 1) AS with_hreflang,
  count(*) FILTER (k % 4 = 0) AS with_open_graph, count(*) FILTER (k % 6 IN (0, 1)) AS with_json_ld, CAST(count(*) FILTER (k % 6 = 2) AS BIGINT) AS json_ld_errors, count(*) FILTER (words < 300) AS thin, CAST(max(k % 6) AS INT) AS max_depth,
  CAST(0 AS BIGINT) AS without_depth, count(*) FILTER (k % 2 = 0) AS in_sitemap, round_even(avg(k % 100), 1) AS mean_kilobytes FROM i""")
def crawl_summary(spark, sf_dir):
    rows = _crawled(spark, sf_dir)
    found = pages.extract(rows, "id").join(rows.select("id", "url", "status", "depth", "in_sitemap", (F.col("id") % 100).cast("double").alias("kilobytes")), "id")
    return pages.summary(found.withColumn("indexable", pages.indexable(F.col("status"), F.col("robots"), F.col("canonical"), F.col("url"))))


@query("""
SELECT type, count(*) AS n FROM (SELECT unnest(CASE s_suppkey % 6 WHEN 0 THEN ['Product'] WHEN 1 THEN ['Organization', 'Brand', 'WebSite'] ELSE [] END) AS type FROM supplier) GROUP BY 1""")
def json_ld_types(spark, sf_dir):
    return pages.type_distribution(pages.extract(_crawled(spark, sf_dir), "id"))


@query("""
WITH r(ref, want) AS (VALUES ('/b', 'https://a.com/b'), ('//c.com/d', 'https://c.com/d'), ('http://e.com/', 'http://e.com/'), ('f', 'https://a.com/p/f'), ('../g', 'https://a.com/g'), ('?q=1', 'https://a.com/p/KEY?q=1'), ('#x', 'https://a.com/p/KEY#x'))
SELECT s_suppkey AS id, ref, replace(want, 'KEY', CAST(s_suppkey AS VARCHAR)) AS url FROM supplier, r""")
def url_resolve(spark, sf_dir):
    refs = F.explode(F.array(*map(F.lit, ("/b", "//c.com/d", "http://e.com/", "f", "../g", "?q=1", "#x"))))
    base = F.concat(F.lit("https://a.com/p/"), "s_suppkey")
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), base.alias("base"), refs.alias("ref")).select("id", "ref", urls.resolve(F.col("base"), F.col("ref")).alias("url"))


@query("""
WITH t(i, raw, decoded, safe, path) AS (VALUES (0, 'https://a.com/x%20y+z?q=1', 'https://a.com/x y+z?q=1', 'a.com-x-20y-z-q-1', '/x%20y+z'), (1, 'https://a.com', 'https://a.com', 'a.com', '/'), (2, 'http://b.org/%zz', 'http://b.org/%zz', 'b.org-zz', '/%zz'), (3, 'https://a.com/caf%C3%A9/', 'https://a.com/café/', 'a.com-caf-C3-A9-', '/caf%C3%A9/'))
SELECT s_suppkey AS id, decoded, safe, path FROM supplier JOIN t ON s_suppkey % 4 = i""")
def url_parts(spark, sf_dir):
    raw = F.element_at(F.array(*map(F.lit, ("https://a.com/x%20y+z?q=1", "https://a.com", "http://b.org/%zz", "https://a.com/caf%C3%A9/"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), raw.alias("raw")).select("id", urls.percent_decode(F.col("raw")).alias("decoded"), urls.file_safe(F.col("raw")).alias("safe"), urls.path(F.col("raw")).alias("path"))


PATHS = ("/", "/blog/a", "/categorie/b", "/produit/c", "/contact", "/panier", "/autre")


@query("""
WITH t(i, template) AS (VALUES (0, 'accueil'), (1, 'article'), (2, 'categorie'), (3, 'produit'), (4, 'service'), (5, 'transactionnel'), (6, 'page')) SELECT template, count(*) AS pages FROM supplier JOIN t ON s_suppkey % 7 = i GROUP BY 1""")
def url_template_branches(spark, sf_dir):
    path = F.element_at(F.array(*map(F.lit, PATHS)), (F.col("s_suppkey") % 7 + 1).cast("int"))
    return read(spark, sf_dir, "supplier").groupBy(urls.template(path).alias("template")).agg(F.count("*").alias("pages"))


# --- crawls ----------------------------------------------------------------------------------------------------

LINKS = "SELECT DISTINCT l_suppkey AS src, 2 * ((l_suppkey + l_linenumber % 3) % ((SELECT count(*) FROM supplier) // 2)) AS dst, l_linenumber % 3 <> 2 AS contextual FROM lineitem"


def _links(spark, sf_dir):
    n = read(spark, sf_dir, "supplier").count()
    return read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (2 * ((F.col("l_suppkey") + F.col("l_linenumber") % 3) % (n // 2))).alias("dst"), (F.col("l_linenumber") % 3 != 2).alias("contextual")).distinct()


def _suppliers(spark, sf_dir):
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"))


def _root(spark):
    return spark.createDataFrame([(0,)], "node long")


@query(f"""
WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM ({LINKS})), w(node, depth) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node WHERE w.depth < 12), d AS (SELECT node, min(depth) AS depth FROM w GROUP BY 1)
SELECT node, depth, 'link' AS found_by FROM d UNION ALL SELECT s_suppkey, NULL, 'declared' FROM supplier WHERE s_suppkey NOT IN (SELECT node FROM d)""")
def two_phase_crawl(spark, sf_dir):
    return graph.two_phase(_links(spark, sf_dir), _root(spark), _suppliers(spark, sf_dir))


@query(f"""
WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM ({LINKS}) WHERE src <> 4), w(node, depth) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node WHERE w.depth < 12), d AS (SELECT node, min(depth) AS depth FROM w GROUP BY 1)
SELECT node, depth, 'link' AS found_by, node <> 4 AS visited FROM d""")
def robots_bound_crawl(spark, sf_dir):
    return graph.crawl(_links(spark, sf_dir), _root(spark), cap=10**6, blocked=spark.createDataFrame([(4,)], "node long"))


@query(f"""
WITH e AS (SELECT DISTINCT src, dst FROM ({LINKS})), a AS (SELECT dst FROM e WHERE src = 0 AND dst <> 0), f AS (SELECT dst, row_number() OVER (ORDER BY dst) AS r FROM a)
SELECT CAST(0 AS BIGINT) AS node, 0 AS depth, true AS visited UNION ALL SELECT dst, 1, r <= 1 FROM f""")
def capped_crawl(spark, sf_dir):
    return graph.crawl(_links(spark, sf_dir), _root(spark), cap=2).select("node", "depth", "visited")


@query(f"""
WITH e AS ({LINKS}), s AS (SELECT s_suppkey AS node, s_nationkey AS silo, s_suppkey % 10 = 0 AS pillar FROM supplier),
i AS (SELECT src, dst, contextual FROM e JOIN s a ON e.src = a.node JOIN s b ON e.dst = b.node WHERE a.silo = b.silo AND src <> dst),
o AS (SELECT src, count(DISTINCT dst) AS n FROM i GROUP BY 1), t AS (SELECT dst, count(*) AS n FROM i WHERE contextual GROUP BY 1)
SELECT node, silo, pillar, coalesce(o.n, 0) AS inside_out, coalesce(t.n, 0) AS contextual_in, CASE WHEN pillar THEN coalesce(o.n, 0) >= 5 ELSE coalesce(t.n, 0) >= 3 END AS ok FROM s LEFT JOIN o ON node = src LEFT JOIN t ON node = dst""")
def silo_counts(spark, sf_dir):
    silo = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("silo"), (F.col("s_suppkey") % 10 == 0).alias("pillar"))
    return graph.silo_counts(_links(spark, sf_dir), silo)


@query(f"""
WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM ({LINKS})), w(node) AS (SELECT dst FROM e WHERE src = 6 UNION SELECT e.dst FROM w JOIN e ON e.src = w.node) SELECT DISTINCT node FROM w""")
def link_closure(spark, sf_dir):
    return graph.closure(_links(spark, sf_dir), spark.createDataFrame([(6,)], "node long"))


@query(f"SELECT dst AS node, count(*) AS links, count(*) FILTER (contextual) AS contextual_links FROM ({LINKS}) GROUP BY 1")
def contextual_in_degree(spark, sf_dir):
    return graph.in_degree(_links(spark, sf_dir), "contextual")


@query(f"SELECT s_suppkey AS node FROM supplier WHERE s_suppkey NOT IN (SELECT dst FROM ({LINKS}))")
def unreached_pages(spark, sf_dir):
    return graph.unreached(_suppliers(spark, sf_dir), _links(spark, sf_dir).select(F.col("dst").alias("node")))


# --- redirects -------------------------------------------------------------------------------------------------

#: Source pattern, target, code, and what a page rule with them is found to lose: kinds and suggestions, in order.
PAGE_RULES = (
    ("example.com/*", "https://w.com/$1", 301, "", ""),
    ("example.com/*", "https://w.com/", 301, "chemin-perdu", "https://w.com/$1"),
    ("*example.com/*", "https://w.com/$1", 301, "chemin-perdu", "https://w.com/$2"),
    ("*example.com/a/*/b/*", "https://w.com/$1", 302, "chemin-perdu,code-non-permanent", "https://w.com/$2"),
    ("example.com/*", "https://w.com/$2", 301, "reference-hors-joker,chemin-perdu", "https://w.com/$2/$1"),
    ("example.com/*", "https://w.com/:splat", 308, "jeton-litteral", "https://w.com/$1"),
    ("example.com/*", "https://w.com/${1}", 301, "forme-non-documentee", ""),
    ("*.example.com/", "https://w.com/:splat", 301, "jeton-litteral", ""),
    ("example.com/*", "https://w.com/$0", 307, "chemin-perdu,code-non-permanent", "https://w.com/$0/$1"),
)
#: The same for lines of a redirects file.
FILE_LINES = (
    ("/blog/*", "https://b.com/:splat", 301, "", ""),
    ("/blog/*", "https://b.com/$1", 301, "jeton-litteral", "https://b.com/:splat"),
    ("/blog/*", "https://b.com", 302, "chemin-perdu,code-non-permanent", "https://b.com/:splat"),
    ("/m/:title", "/media/:title", 301, "", ""),
    ("/m/:title/:part", "/media/", 301, "chemin-perdu", "/media/:title"),
    ("/page", "https://b.com/:splat", 301, "reference-hors-joker", ""),
    ("/page", "/who/:name", 301, "reference-hors-joker", ""),
    ("/a/*/*", "/b/:splat", 301, "ligne-ignoree", ""),
    ("/page", "/other", None, "code-non-permanent", ""),
)
CASES = [("page-rules", *r) for r in PAGE_RULES] + [("fichier-redirects", *r) for r in FILE_LINES]
_SQL_CASES = ", ".join(f"({i}, '{v}', '{kinds}', '{new}')" for i, (v, _, _, _, kinds, new) in enumerate(CASES))


def _rules(spark, sf_dir):
    """One rule for each part, of one of the cases; targets carry the part's number where that changes nothing."""
    cases = spark.createDataFrame([(i, v, s, t, c) for i, (v, s, t, c, _, _) in enumerate(CASES)], "case int, vehicle string, source string, target string, code int")
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % len(CASES)).cast("int").alias("case"))
    none = F.lit(None)
    return part.join(cases, "case").select("id", "vehicle", "source", "target", "code", F.lit(True).alias("readable"), none.cast("boolean").alias("many"), none.cast("boolean").alias("keeps"), none.cast("string").alias("field"))


@query(f"""
WITH c(i, vehicle, kinds, suggestions) AS (VALUES {_SQL_CASES})
SELECT p_partkey AS id, vehicle, kinds, suggestions, kinds <> '' AND regexp_matches(kinds, 'chemin-perdu|jeton-litteral') OR i IN (4, {len(PAGE_RULES) + 5}) AS blocking FROM part JOIN c ON p_partkey % {len(CASES)} = i""")
def redirect_findings(spark, sf_dir):
    found = redirects.findings(_rules(spark, sf_dir))
    told = F.filter(F.transform("findings", lambda f: f["suggestion"]), lambda x: x.isNotNull())
    return found.select("id", "vehicle", F.array_join(F.transform("findings", lambda f: f["kind"]), ",").alias("kinds"), F.array_join(told, ",").alias("suggestions"), "blocking")


@query("""
WITH c(i, stars, path) AS (VALUES (0, 1, 1), (1, 2, 2), (2, 3, 2), (3, 1, NULL), (4, 2, 2), (5, 1, 1), (6, 1, 1), (7, 0, NULL))
SELECT p_partkey AS id, stars, path FROM part JOIN c ON p_partkey % 8 = i""")
def wildcard_ranks(spark, sf_dir):
    patterns = ("example.com/*", "*example.com/*", "*example.com/a/*/b/*", "*.example.com/", "http*://example.com/x/*", "/app/*", "example.com*", "https://e.com/\\*")
    p = F.element_at(F.array(*map(F.lit, patterns)), (F.col("p_partkey") % 8 + 1).cast("int"))
    stars, path = redirects.wildcards(p, escaped=True)
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), stars.alias("stars"), path.alias("path"))


EXPORTS = """
{"result": [{"id": "p%d", "status": "active", "targets": [{"constraint": {"value": "e.com/*"}}], "actions": [{"id": "forwarding_url", "value": {"url": "https://w.com/%s", "status_code": 301}}]}, {"id": "off", "status": "disabled", "targets": [], "actions": []}]}
{"result": {"rules": [{"id": "s%d", "action": "redirect", "expression": "http.host eq \\"o.com\\"", "action_parameters": {"from_value": {"target_url": {"value": "https://w.com/"}, "status_code": 301}}}]}}
{"result": {"rules": [{"id": "w%d", "action": "redirect", "expression": "true", "action_parameters": {"from_value": {"target_url": {"expression": "wildcard_replace(http.request.full_uri, r\\"/app/*\\", r\\"/apps/${1}\\")"}, "status_code": 302}}}]}}
{"result": {"rules": [{"id": "d%d", "action": "redirect", "expression": "http.host eq \\"o.com\\"", "action_parameters": {"from_value": {"target_url": {"expression": "concat(\\"https://n.com\\", http.request.uri.path)"}, "status_code": 301}}}]}}
{"result": [{"id": "b%d", "redirect": {"source_url": "e.com/a/", "target_url": "https://e.com/b/", "status_code": 301, "subpath_matching": true, "preserve_path_suffix": false}}]}
{"result": [{"id": "k%d", "redirect": {"source_url": "e.com/a/", "target_url": "https://e.com/b/", "status_code": 301, "subpath_matching": true}}]}
""".strip().split("\n")


def _exports(spark, sf_dir):
    k = F.col("s_suppkey").cast("string")
    lines = F.element_at(F.array(*[F.replace(F.replace(F.lit(e), F.lit("%d"), k), F.lit("%s"), F.when(F.col("s_suppkey") % 4 == 0, "$1").otherwise("")) for e in EXPORTS]), (F.col("s_suppkey") % 6 + 1).cast("int"))
    return read(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), lines.alias("text"))


JUDGED = """
SELECT s_suppkey AS k, s_name AS name, ['p', 's', 'w', 'd', 'b', 'k'][s_suppkey % 6 + 1] || s_suppkey AS id,
  ['page-rules', 'single-redirects-statique', 'single-redirects-joker', 'single-redirects-dynamique', 'bulk-redirects', 'bulk-redirects'][s_suppkey % 6 + 1] AS vehicle,
  [CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'chemin-perdu' END, 'chemin-perdu', 'motif-jamais-apparie,code-non-permanent', '', 'chemin-perdu', ''][s_suppkey % 6 + 1] AS kinds FROM supplier"""


@query(f"SELECT name, id, vehicle, kinds, kinds <> '' AS blocking FROM ({JUDGED})")
def redirect_exports(spark, sf_dir):
    found = redirects.judged(_exports(spark, sf_dir))
    return found.select("name", "id", "vehicle", F.array_join(F.transform("findings", lambda f: f["kind"]), ",").alias("kinds"), "blocking")


@query(f"""
WITH j AS ({JUDGED}), w AS (SELECT id, kinds = 'chemin-perdu' AND k % 3 = 1 AS waived FROM j) SELECT j.id, waived FROM j JOIN w USING (id)""")
def waived_redirects(spark, sf_dir):
    waivers = read(spark, sf_dir, "supplier").where("s_suppkey % 3 = 1").select(F.concat(F.element_at(F.array(*map(F.lit, "pswdbk")), (F.col("s_suppkey") % 6 + 1).cast("int")), "s_suppkey").alias("id"))
    return redirects.waived(redirects.judged(_exports(spark, sf_dir)), waivers).select("id", "waived")


@query(f"SELECT id FROM ({JUDGED}) WHERE k % 2 = 1 AND kinds = ''")
def unused_redirect_waivers(spark, sf_dir):
    waivers = read(spark, sf_dir, "supplier").where("s_suppkey % 2 = 1").select(F.concat(F.element_at(F.array(*map(F.lit, "pswdbk")), (F.col("s_suppkey") % 6 + 1).cast("int")), "s_suppkey").alias("id"))
    return redirects.unused_waivers(redirects.judged(_exports(spark, sf_dir)), waivers)


@query(f"""
WITH j AS ({JUDGED}), b AS (SELECT *, kinds <> '' AS blocking, k % 3 = 1 AS w FROM j)
SELECT count(*) AS judged, count(*) FILTER (NOT blocking OR w) AS conforming, count(*) FILTER (blocking AND w) AS waived, CASE WHEN count(*) = count(*) FILTER (NOT blocking OR w) THEN 'PASS' ELSE 'FAIL' END AS verdict FROM b""")
def redirect_compliance(spark, sf_dir):
    judged = redirects.judged(_exports(spark, sf_dir)).withColumn("judged", F.lit(True))
    return rules.fold_compliance(judged, judged.where("int(substring(id, 2)) % 3 = 1").select("id"))


@query("""
WITH p(i, code, location) AS (VALUES (0, 301, 'https://n.com/w/x'), (1, 301, '/'), (2, 301, '/n/$1'), (3, 308, '/n/$%7B1%7D'), (4, 302, '/n/w/x'), (5, 200, NULL), (6, 0, NULL)),
f(i, kinds, judged, blocking) AS (VALUES (0, '', true, false), (1, 'chemin-perdu', true, true), (2, 'jeton-litteral', true, true), (3, 'jeton-litteral', true, true), (4, 'code-non-permanent', true, false), (5, 'sans-redirection', true, false), (6, '', false, false))
SELECT o_orderkey AS url, kinds, judged, blocking FROM orders JOIN f ON o_orderkey % 7 = i""")
def probe_findings(spark, sf_dir):
    rows = [(0, 301, "https://n.com/w/x"), (1, 301, "/"), (2, 301, "/n/$1"), (3, 308, "/n/$%7B1%7D"), (4, 302, "/n/w/x"), (5, 200, None), (6, 0, None)]
    answers = spark.createDataFrame(rows, "i int, code int, location string")
    probes = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("url"), (F.col("o_orderkey") % 7).cast("int").alias("i")).join(answers, "i").withColumn("witness", F.lit("w/x"))
    return redirects.judge_probes(probes).select("url", F.array_join(F.transform("findings", lambda f: f["kind"]), ",").alias("kinds"), "judged", "blocking")


@query("""
WITH p AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 10 = 3 THEN 301 WHEN s_suppkey % 10 = 7 THEN 404 ELSE 200 END AS status, s_suppkey % 10 = 3 AS hops, (s_suppkey * 7 + 1) % ((SELECT count(*) FROM supplier) + 5) AS c, s_suppkey % 2 = 0 AS has_c, s_suppkey % 3 = 0 AS in_sitemap FROM supplier),
d AS (SELECT 'U1' AS rule, c AS target FROM p WHERE has_c UNION ALL SELECT 'U2', (k + 3) % (SELECT count(*) FROM supplier) FROM p WHERE k % 4 = 1 UNION ALL SELECT 'U3', k FROM p WHERE in_sitemap),
j AS (SELECT rule, target, CASE WHEN p.k IS NULL THEN 'UNSEEN' WHEN p.status = 200 AND NOT p.hops THEN 'PASS' ELSE 'FAIL' END AS v FROM d LEFT JOIN p ON target = p.k)
SELECT rule, CASE WHEN bool_or(v = 'FAIL') THEN 'FAIL' WHEN bool_or(v = 'PASS') THEN 'PASS' ELSE 'SANS_OBJET' END AS verdict, count(*) AS subjects, count(*) FILTER (v = 'FAIL') AS failed, count(*) FILTER (v = 'UNSEEN') AS unseen,
  coalesce(array_to_string((list_sort(list(DISTINCT CAST(target AS VARCHAR)) FILTER (v = 'FAIL')))[1:6], ','), '') AS examples FROM j GROUP BY 1""")
def declared_url_rules(spark, sf_dir):
    supplier = read(spark, sf_dir, "supplier")
    n, k, none = supplier.count(), F.col("s_suppkey"), F.array().cast("array<string>")
    page = supplier.select(
        k.cast("string").alias("url"), F.when(k % 10 == 3, 301).when(k % 10 == 7, 404).otherwise(200).alias("status"), F.when(k % 10 == 3, F.array(F.lit("x"))).otherwise(none).alias("redirects"), F.when(k % 2 == 0, ((k * 7 + 1) % (n + 5)).cast("string")).alias("canonical"),
        F.when(k % 4 == 1, F.array(F.struct(F.lit("fr").alias("lang"), ((k + 3) % n).cast("string").alias("href")))).otherwise(F.array().cast("array<struct<lang: string, href: string>>")).alias("hreflang"), (k % 3 == 0).alias("in_sitemap"),
    )
    return rules.declared_urls(page).withColumn("examples", F.array_join("examples", ","))


# --- logs ------------------------------------------------------------------------------------------------------


@query("""
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS agent, count(*) AS hits, count(*) FILTER (event_id % 3 = 0) AS failed, round_even(count(*) FILTER (event_id % 3 = 0) / CAST(count(*) AS DOUBLE), 3) AS failure_rate FROM events GROUP BY 1, 2""")
def windowed_breakdown(spark, sf_dir):
    hits = read(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("agent"), F.when(F.col("event_id") % 3 == 0, 404).otherwise(200).alias("status"))
    return stream.windowed_breakdown(hits, "ts", "agent", "status").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS end, count(*) AS hits FROM s GROUP BY user_id, n""")
def visit_sessions(spark, sf_dir):
    hits = read(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    found = stream.visits(hits, "ts", "user_id")
    return found.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "hits")


@query("""
WITH r AS (SELECT o_custkey AS k, o_orderkey AS run, o_orderdate AS d, o_totalprice > 250000 AS measured FROM orders)
SELECT k, run, measured FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY measured DESC, d DESC, run DESC) AS n FROM r) WHERE n = 1""")
def latest_measured(spark, sf_dir):
    runs = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("run"), F.struct("o_orderdate", "o_orderkey").alias("d"), (F.col("o_totalprice") > 250000).alias("measured"))
    return logs.latest_measured(runs, ["k"], date="d").select("k", "run", "measured")


@query("SELECT 'logs' AS source, 'non-mesurable' AS verdict, CAST(NULL AS BIGINT) AS read, CAST(NULL AS BIGINT) AS recognised, CAST(NULL AS BIGINT) AS ignored, 'access log' AS missing, 'give one' AS remedy")
def no_log_no_counter(spark, sf_dir):
    return logs.not_measurable(spark, "logs", "access log", "give one")


@query("SELECT event_type AS agent, count(*) AS n FROM events GROUP BY 1")
def agents_by_count(spark, sf_dir):
    return table.by_count(read(spark, sf_dir, "events").select(F.col("event_type").alias("agent")), "agent")


@query("""
WITH a(i, word, slug) AS (VALUES (0, 'L''Été à Nîmes !', 'l-ete-a-nimes'), (1, '  Crème   brûlée 2 ', 'creme-brulee-2'), (2, '---', ''), (3, 'Œuvre & Cie', 'uvre-cie'))
SELECT s_suppkey AS id, slug, lower(trim(regexp_replace(word, '\\s+', ' ', 'g'))) AS token FROM supplier JOIN a ON s_suppkey % 4 = i""")
def slugs(spark, sf_dir):
    word = F.element_at(F.array(*map(F.lit, ("L'Été à Nîmes !", "  Crème   brûlée 2 ", "---", "Œuvre & Cie"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), text.slug(word).alias("slug"), text.token(word).alias("token"))
