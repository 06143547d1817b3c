"""Queries over templates, seasons, nested documents, versions, collations and folders of files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.functions import text, urls
from tidewrack.operators import redirects, scoring, snapshot, table, templates, versions
from tidewrack.plans.registry import query, read
from tidewrack.session import shared_folder
from tidewrack.sources import documents, pages, sitemaps

# --- templates -------------------------------------------------------------------------------------------------

#: The blocks of the pages of the one layout that the tables have.
PAGE_BLOCKS = r"""
h AS (SELECT page_id AS page, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, regexp_replace(regexp_replace(coalesce(html, ''), '<!--.*?-->', '', 'gs'), '<(script|style)[^>]*>.*?</(script|style)>', '', 'gs') AS html FROM pages),
x AS (SELECT page, host, regexp_extract(html, '<nav>(.*?)</nav>', 1, 's') AS nav, regexp_extract(html, '</nav><div class="ad">(.*?)</div>', 1, 's') AS ad, regexp_extract(html, '<article><h1>(.*?)</h1>', 1, 's') AS head, regexp_extract(html, '</h1>(.*?)</article>', 1, 's') AS body, regexp_extract(html, '<footer>(.*?)</footer>', 1, 's') AS foot FROM h),
raw AS (SELECT page, host, 'html/body/nav/ul/li' AS path, unnest(regexp_extract_all(nav, '<li>(.*?)</li>', 1, 's')) AS t FROM x
  UNION ALL SELECT page, host, 'html/body/div', ad FROM x UNION ALL SELECT page, host, 'html/body/article/h1', head FROM x
  UNION ALL SELECT page, host, 'html/body/article/p', unnest(regexp_split_to_array(replace(body, '<br>', ' '), '</?p>')) FROM x UNION ALL SELECT page, host, 'html/body/footer', foot FROM x),
b AS (SELECT page, host, path, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(t, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&copy;', '©'), '&middot;', '·'), '&nbsp;', chr(160)), '&amp;', '&'), '[\s\x{A0}]+', ' ', 'g')) AS text FROM raw),
blocks AS (SELECT * FROM b WHERE text <> ''),
sizes AS (SELECT host, count(DISTINCT page) AS n FROM blocks GROUP BY 1),
template AS (SELECT host, path, text, count(DISTINCT page) AS pages FROM blocks JOIN sizes USING (host) GROUP BY host, path, text, n HAVING count(DISTINCT page) >= 2 AND count(DISTINCT page) >= 0.2 * n)"""


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "pages").select(F.struct("page_id", "url").alias("at"), "html")
    host = F.lower(F.regexp_extract("at.url", "://([^/?#]*)", 1))
    return pages.blocks(rows.select(F.to_json("at").alias("at"), "html"), "at").withColumn("at", F.from_json("at", "page_id long, url string")).select(host.alias("host"), F.col("at.page_id").alias("page"), "position", "path", "text")


@query(f"WITH {PAGE_BLOCKS} SELECT host, path, text, pages FROM template")
def page_templates(spark, sf_dir):
    return templates.template_blocks(_blocks(spark, sf_dir)).drop("a", "b")


@query(f"""WITH {PAGE_BLOCKS},
w AS (SELECT page, t.pages IS NULL AS own, len(string_split(b.text, ' ')) AS n FROM blocks b LEFT JOIN template t ON b.host = t.host AND b.path = t.path AND b.text = t.text)
SELECT page, CAST(sum(n) AS BIGINT) AS words, CAST(coalesce(sum(n) FILTER (own), 0) AS BIGINT) AS own_words, coalesce(sum(n) FILTER (own), 0) / CAST(sum(n) AS DOUBLE) AS value, coalesce(sum(n) FILTER (own), 0) / CAST(sum(n) AS DOUBLE) >= 0.4 AS ok FROM w GROUP BY page""")
def content_outside_template(spark, sf_dir):
    blocks = _blocks(spark, sf_dir)
    return templates.own_share(templates.own_blocks(blocks, templates.template_blocks(blocks)))


# --- seasons ---------------------------------------------------------------------------------------------------


@query("""
WITH m AS (SELECT o_orderpriority AS key, date_trunc('month', o_orderdate)::DATE AS month, CAST(count(*) AS DOUBLE) AS value, year(o_orderdate) * 12 + month(o_orderdate) AS p FROM orders GROUP BY 1, 2, 4),
t AS (SELECT *, CASE WHEN count(*) OVER w6 = 13 THEN (sum(value) OVER w5 + (sum(value) OVER lo + sum(value) OVER hi) / 2) / 12 END AS trend FROM m
  WINDOW w6 AS (PARTITION BY key ORDER BY p RANGE BETWEEN 6 PRECEDING AND 6 FOLLOWING), w5 AS (PARTITION BY key ORDER BY p RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING),
  lo AS (PARTITION BY key ORDER BY p RANGE BETWEEN 6 PRECEDING AND 6 PRECEDING), hi AS (PARTITION BY key ORDER BY p RANGE BETWEEN 6 FOLLOWING AND 6 FOLLOWING)),
i AS (SELECT key, month(month) AS c, avg(value - trend) AS i FROM t WHERE trend IS NOT NULL GROUP BY 1, 2),
s AS (SELECT key, c, CASE WHEN count(*) OVER (PARTITION BY key) = 12 THEN i - avg(i) OVER (PARTITION BY key) END AS seasonal FROM i)
SELECT t.key, month, value, round(trend, 6) AS trend, round(seasonal, 6) AS seasonal, round(value - trend - seasonal, 6) AS remainder FROM t LEFT JOIN s ON s.key = t.key AND s.c = month(t.month)""")
def seasonal_orders(spark, sf_dir):
    """What each priority's monthly orders owe to the trend, to the month of the year, and to neither."""
    orders = read(spark, sf_dir, "orders")
    series = orders.groupBy(F.col("o_orderpriority").alias("key"), F.trunc("o_orderdate", "month").cast("date").alias("month")).agg(F.count("*").cast("double").alias("value"))
    found = table.seasonal(series, "key", "month", "value")
    return found.select("key", "month", "value", *[F.round(c, 6).alias(c) for c in ("trend", "seasonal", "remainder")])


# --- nested documents ------------------------------------------------------------------------------------------


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part's document: metrics within metrics, as deep as a third of its size, 17 at most."""
    depth = F.ceil(F.col("p_size") / 3).cast("int")
    opens = F.concat(F.lit('{"cle":"'), "p_partkey", F.lit('","preuve":"T'), (F.col("p_size") % 4 + 1).cast("string"), F.lit('","more":['))
    return read(spark, sf_dir, "part").select("p_partkey", "p_size", F.concat(F.repeat(opens, depth), F.repeat(F.lit("]}"), depth)).alias("body"))


@query("""
SELECT p_partkey AS id, '$' || repeat('.more[0]', CAST(d AS INT)) AS path, CAST(p_partkey AS VARCHAR) AS cle, 'T' || (p_size % 4 + 1) AS preuve FROM (SELECT p_partkey, p_size, unnest(range(CAST(ceil(p_size / 3.0) AS INT))) AS d FROM part)""")
def nested_metrics(spark, sf_dir):
    """All metrics of documents nested up to 17 levels deep."""
    return snapshot.tagged_metrics(_nested(spark, sf_dir).select(F.col("p_partkey").alias("id"), "body"))


#: A contract that holds itself: a metric's key is text, its tier one of two, its members are metrics, one at most.
SELF_HOLDING = {
    "$ref": "#/$defs/metric",
    "$defs": {"metric": {"type": "object", "required": ["cle", "preuve"], "additionalProperties": False, "properties": {"cle": {"type": "string"}, "preuve": {"enum": ["T1", "T2", "T3"]}, "more": {"type": "array", "maxItems": 1, "items": {"$ref": "#/$defs/metric"}}}}},
}


@query("""
SELECT p_partkey AS id, CASE WHEN p_size % 4 < 3 THEN 0 ELSE CAST(ceil(p_size / 3.0) AS INT) END AS n, CASE WHEN p_size % 4 = 3 THEN '$' || repeat('.more[0]', CAST(ceil(p_size / 3.0) AS INT) - 1) || '.preuve' END AS deepest FROM part""")
def nested_contract(spark, sf_dir):
    """How often a document breaks a contract that holds itself, and how deep."""
    judged = snapshot.contract_violations(_nested(spark, sf_dir), SELF_HOLDING)
    places = F.transform("violations", lambda v: F.split(v, ": ")[0])
    deepest = F.array_max(F.transform(places, lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"]
    return judged.select(F.col("p_partkey").alias("id"), F.size("violations").alias("n"), deepest.alias("deepest"))


# --- versions --------------------------------------------------------------------------------------------------


@query("""
SELECT 1 AS number, '20260101a' AS name, count(*) AS rows, CAST(sum(c_nationkey) AS BIGINT) AS nations FROM customer
UNION ALL SELECT 2, '20260101b', count(*), CAST(sum(c_nationkey + 1) AS BIGINT) FROM customer UNION ALL SELECT 3, '20260102a', count(*), CAST(sum(c_nationkey) AS BIGINT) FROM customer WHERE c_acctbal >= 0""")
def published_versions(spark, sf_dir):
    """Four publications of the customers over two days, one of them without a change."""
    rows = read(spark, sf_dir, "customer")
    kept = versions.Versions(spark, f"{shared_folder(spark)}/versions-{uuid.uuid4().hex}")
    moved = rows.withColumn("c_nationkey", F.col("c_nationkey") + 1)
    kept.publish(rows, "20260101")
    kept.publish(rows.orderBy(F.desc("c_custkey")), "20260101")
    kept.publish(moved, "20260101")
    kept.publish(rows.where("c_acctbal >= 0"), "20260102")
    out = None
    for e in kept.log():
        one = kept.read(e.name).agg(F.count("*").alias("rows"), F.sum("c_nationkey").cast("long").alias("nations")).select(F.lit(e.number).alias("number"), F.lit(e.name).alias("name"), "rows", "nations")
        out = one if out is None else out.unionByName(one)
    return out


@query("""
SELECT 's/' || s_suppkey || '.md' AS path, CASE WHEN s_nationkey % 3 = 0 THEN 'create' WHEN s_nationkey % 3 = 1 THEN 'replace' WHEN s_suppkey % 2 = 0 THEN 'keep' ELSE 'same' END AS plan,
       CASE WHEN s_nationkey % 3 <> 2 THEN 'new ' || s_name WHEN s_suppkey % 2 = 0 THEN 'edited ' || s_name ELSE 'new ' || s_name END AS content FROM supplier""")
def synced_files(spark, sf_dir):
    """A second write of files after some were edited: a third is new, a third untouched, the others edited or up to date."""
    supplier = read(spark, sf_dir, "supplier")
    file = lambda rows, word: rows.select(F.concat(F.lit("s/"), "s_suppkey", F.lit(".md")).alias("path"), F.concat(F.lit(word), "s_name").alias("content"))
    files = versions.Files(spark, f"{shared_folder(spark)}/files-{uuid.uuid4().hex}")
    files.write(file(supplier.where("s_nationkey % 3 = 1"), "old ").union(file(supplier.where("s_nationkey % 3 = 2"), "new ")), "20260101")
    files.edit(file(supplier.where("s_nationkey % 3 = 2 and s_suppkey % 2 = 0"), "edited "), "20260101")
    plan = files.write(file(supplier, "new "), "20260102", force=True)
    return files.state()[0].select("path", "content").join(plan, "path")


# --- collations ------------------------------------------------------------------------------------------------


@query("SELECT doc_id FROM documents WHERE contains(strip_accents(lower(coalesce(text, ''))), 'ete')")
def collated_search(spark, sf_dir):
    return table.locale_search(read(spark, sf_dir, "documents"), ["text"], "ÉTÉ").select("doc_id")


@query(r"""
SELECT min(w) AS word, CAST(count(*) AS BIGINT) AS n, count(DISTINCT w) AS forms FROM (SELECT unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS w FROM conversations)
GROUP BY strip_accents(replace(lower(w), 'ß', 'ss'))""")
def collated_groups(spark, sf_dir):
    words = read(spark, sf_dir, "conversations").select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-zÀ-ÿ]+"), 0)).alias("word"))
    return table.locale_groups(words, "word")


# --- folders ---------------------------------------------------------------------------------------------------


@query("""
SELECT 'actions-' || r_regionkey || '.csv' AS file, CASE r_regionkey % 4 WHEN 0 THEN ',' WHEN 1 THEN ';' WHEN 2 THEN chr(9) ELSE '|' END AS delimiter, CAST(n_nationkey AS VARCHAR) AS id,
       n_name || ', "the" ' || chr(10) || 'one; or | other' AS libelle, CAST(n_nationkey % 5 + 1 AS VARCHAR) AS gain FROM nation JOIN region ON n_regionkey = r_regionkey""")
def action_folder(spark, sf_dir):
    """A file of actions for each region, each with a delimiter of its own, read together."""
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    delimiter = F.element_at(F.array(*map(F.lit, documents.DELIMITERS)), (F.col("r_regionkey") % 4 + 1).cast("int"))
    label = F.concat(F.lit('"'), F.replace(F.concat("n_name", F.lit(', "the" \none; or | other')), F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws("_D_", F.col("n_nationkey").cast("string"), label, (F.col("n_nationkey") % 5 + 1).cast("string"))
    rows = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey").agg(F.concat_ws("\n", F.array_sort(F.collect_list(line))).alias("rows"))
    text = F.replace(F.concat(F.lit("id_D_libelle_D_gain\n"), "rows"), F.lit("_D_"), delimiter)
    folder = f"{shared_folder(spark)}/actions-{uuid.uuid4().hex}"
    rows.select(F.concat(F.lit("actions-"), "r_regionkey", F.lit(".csv")).alias("name"), text.alias("value")).repartition("name").write.partitionBy("name").option("lineSep", "\n\n").text(folder)
    found = documents.read_action_folder(spark, folder)
    return found.select(F.regexp_extract("path", r"(actions-\d+\.csv)", 1).alias("file"), "delimiter", *[F.col("cells")[c].alias(c) for c in ("id", "libelle", "gain")])


@query("""
WITH f AS (SELECT DISTINCT p_size % 7 AS a, p_size % 3 AS b FROM part)
SELECT 'kind=' || a || '/run=' || b AS folder FROM f WHERE a <> 2""")
def discovered_folders(spark, sf_dir):
    """One marker file in each folder that Spark wrote, but for a folder that is left out."""
    part = read(spark, sf_dir, "part").select((F.col("p_size") % 7).alias("kind"), (F.col("p_size") % 3).alias("run"), "p_partkey")
    folder = f"{shared_folder(spark)}/found-{uuid.uuid4().hex}"
    markers = part.groupBy("kind", "run").agg(F.count("*").alias("n"))
    markers.repartition("kind", "run").write.partitionBy("kind", "run").parquet(folder)
    found = documents.scan(spark, folder, r"^part-.*\.parquet$", excluded=("kind=2",))
    return found.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"))


# --- texts and labels over whole columns -----------------------------------------------------------------------

#: Blanks of any script, as one.
BLANKS_SQL = r"[\s\x0b\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


@query(f"""
WITH p AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '{BLANKS_SQL}', ' ', 'g')) AS t FROM documents),
e AS (SELECT doc_id, t, list_min(list_filter([instr(t, ' : '), instr(t, ' — '), instr(t, ' – '), instr(t, '. '), instr(t, ' ; ')], lambda i: i BETWEEN 2 AND 171)) AS e FROM p)
SELECT doc_id, CASE WHEN e IS NULL THEN t ELSE trim(substr(t, 1, e - 1), ' .;:—–') END AS head FROM e""")
def document_heads(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.first_sentence(F.col("text")).alias("head"))


FOUND_TEXT = "CASE WHEN n_chars % 2 = 0 THEN n_chars || ' Lignes lues' WHEN n_chars % 3 = 0 THEN '`' || source || '`' ELSE 'ligne ' || n_chars END || CASE WHEN lang = 'fr' THEN ', fichier INTROUVABLE' WHEN lang = 'de' THEN ' code 404' ELSE ' absente' END"


@query(rf"""
WITH t AS (SELECT doc_id, {FOUND_TEXT} AS t FROM documents)
SELECT doc_id, regexp_matches(t, '(?i)«[^»]{{3,}}»|`[^`]{{3,}}`|\b\d+\s*(?:URL|lien|entr[ée]e|section|ligne|item|rubrique)s?\b') AS read, regexp_matches(t, '(?i)\b(absent|introuvable|n''existe pas|404|non servi|aucun llms)\b') AS absent FROM t""")
def evidence_of_reading(spark, sf_dir):
    told = F.expr(FOUND_TEXT)
    return read(spark, sf_dir, "documents").select("doc_id", text.read_evidence(told).alias("read"), text.says_absent(told).alias("absent"))


#: Conditions of redirect rules; KEY stands for a supplier's number.
CONDITIONS = (
    'http.host eq "aKEY.com"', 'http.request.uri.path eq "/p/KEY"', 'http.request.full_uri wildcard r"https://*/KEY/*"', 'starts_with(http.request.uri.path, "/KEY")', 'http.request.uri in {"/KEY"}', 'http.cookie contains "KEY" and http.request.uri.path eq "/a"',
    'http.request.uri.path ne "/KEY"', 'http.request.uri.path wildcard "/KEY"', 'http.request.uri.path eq "/x" and http.user_agent ~ "KEY"', 'http.request.uri.path matches "KEY"',
)
CONDITION_SQL = "replace([" + ", ".join(f"'{c}'" for c in CONDITIONS) + f"][s_suppkey % {len(CONDITIONS)} + 1], 'KEY', CAST(s_suppkey AS VARCHAR))"


@query(rf"""
WITH c AS (SELECT s_suppkey AS id, {CONDITION_SQL} AS c FROM supplier)
SELECT id, CASE WHEN NOT regexp_matches(c, 'http\.request\.(uri\.path|uri\b|full_uri)') THEN true
  WHEN regexp_matches(c, '\bwildcard\b\s*r?#?"[^"]*\*|\b(starts_with|ends_with)\(\s*http\.request\.(uri\.path|uri|full_uri)|\b(matches|contains)\b|\s~\s') THEN true
  WHEN regexp_matches(c, 'http\.request\.(uri\.path|uri|full_uri)\s+(eq|==|in\b)') THEN false END AS many FROM c""")
def paths_covered(spark, sf_dir):
    condition = F.replace(F.element_at(F.array(*map(F.lit, CONDITIONS)), (F.col("s_suppkey") % len(CONDITIONS) + 1).cast("int")), F.lit("KEY"), F.col("s_suppkey").cast("string"))
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), redirects.covers_many(condition).alias("many"))


@query("""
WITH a AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'IA' WHEN 'O' THEN 'MANUEL' ELSE 'autre' END AS x, CASE WHEN o_orderstatus = 'O' AND o_totalprice > 250000 THEN 'PAYANT' ELSE 'GRATUIT' END AS c, o_orderkey % 6 AS effort, o_totalprice AS score FROM orders),
g AS (SELECT x, c, count(*) AS n, CAST(sum(CASE WHEN effort > 0 THEN effort END) AS BIGINT) AS effort, arg_min(id, (-score, id)) AS best FROM a GROUP BY 1, 2)
SELECT v.x || ' + ' || w.c AS quadrant, coalesce(n, 0) AS n, coalesce(effort, 0) AS effort, CASE WHEN n IS NULL THEN '—' ELSE 'Action ' || best END AS head
FROM (VALUES ('IA'), ('MANUEL')) v(x) CROSS JOIN (VALUES ('GRATUIT'), ('PAYANT')) w(c) LEFT JOIN g ON g.x = v.x AND g.c = w.c""")
def four_quadrants(spark, sf_dir):
    """The four quadrants of a fixed matrix; the paid one of the first axis has no action."""
    k = F.col("o_orderkey")
    axis = F.when(F.col("o_orderstatus") == "F", "IA").when(F.col("o_orderstatus") == "O", "MANUEL").otherwise("autre")
    cost = F.when((F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 250000), "PAYANT").otherwise("GRATUIT")
    effort = F.when(k % 6 == 0, "soon").otherwise((k % 6).cast("string"))
    rows = read(spark, sf_dir, "orders").select(k.alias("id"), axis.alias("axe_execution"), cost.alias("axe_cout"), effort.alias("effort"), F.col("o_totalprice").alias("score"), F.lit(None).cast("string").alias("action"), F.concat(F.lit("Action "), k.cast("string"), F.lit(" : then more")).alias("libelle"))
    return scoring.fixed_quadrants(rows)


@query("""
SELECT CAST(89 AS BIGINT) AS total, count(*) FILTER (l_returnflag = 'R') AS fait, count(*) FILTER (l_returnflag = 'N') AS en_cours, CAST(0 AS BIGINT) AS hors_perimetre, count(*) FILTER (l_returnflag = 'A') AS a_faire FROM lineitem""")
def counters_of_the_grid(spark, sf_dir):
    state = F.when(F.col("l_returnflag") == "R", "fait").when(F.col("l_returnflag") == "N", "en-cours")
    return snapshot.state_counters(read(spark, sf_dir, "lineitem").select(state.alias("state")), "state")


@query("""
SELECT page_id, CASE WHEN path = '' THEN '/' ELSE path END AS path, safe, decoded FROM (
SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_replace(regexp_replace(url, '^https?://', ''), '[^a-zA-Z0-9._-]+', '-', 'g') AS safe, replace(replace(url, '+', '%2B'), '%2B', '+') AS decoded FROM pages)""")
def page_url_parts(spark, sf_dir):
    url = F.col("url")
    return read(spark, sf_dir, "pages").select("page_id", urls.path(url).alias("path"), urls.file_safe(url).alias("safe"), urls.percent_decode(url).alias("decoded"))


@query("""
WITH r AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS base, unnest(regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1, 's'), 'href="([^"]*)"', 1)) AS href FROM pages)
SELECT page_id, href, base || href AS target, count(*) AS n FROM r WHERE starts_with(href, '/') GROUP BY ALL""")
def resolved_links(spark, sf_dir):
    """Links of the pages' menus, as whole addresses."""
    rows = read(spark, sf_dir, "pages").select("page_id", "url", F.explode(F.regexp_extract_all(F.regexp_extract("html", "(?s)<nav>(.*?)</nav>", 1), F.lit('href="([^"]*)"'), 1)).alias("href"))
    met = rows.where(F.startswith("href", F.lit("/"))).select("page_id", "href", urls.resolve(F.col("url"), F.col("href")).alias("target"))
    return met.groupBy("page_id", "href", "target").agg(F.count("*").alias("n"))


@query(r"""
SELECT doc_id, trim(regexp_replace(lower(strip_accents(replace(replace(replace(coalesce(text, ''), 'ß', ''), '''', ' '), '’', ' '))), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM documents""")
def document_slugs(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.slug(F.coalesce("text", F.lit(""))).alias("slug"))


ROBOTS = """User-agent: other
Disallow: /

User-agent: crawler
User-agent: *
Allow: /p/1
Disallow: /p/KEY # own
Disallow: /p/9%30

Disallow: /p/2
User-agent: *
Disallow: /"""


@query("""
SELECT h.n_nationkey AS host, p.s_suppkey AS page, starts_with('/p/' || p.s_suppkey, '/p/1') OR NOT (starts_with('/p/' || p.s_suppkey, '/p/' || h.n_nationkey) OR starts_with('/p/' || p.s_suppkey, '/p/90')) AS allowed
FROM nation h JOIN supplier p ON p.s_nationkey % 5 = h.n_regionkey""")
def robots_groups(spark, sf_dir):
    """Pages under robots rules with groups, comments, encoded paths and rules outside any group."""
    nation, supplier = read(spark, sf_dir, "nation"), read(spark, sf_dir, "supplier")
    robots = nation.select(F.col("n_nationkey").alias("host"), F.replace(F.lit(ROBOTS), F.lit("KEY"), F.col("n_nationkey").cast("string")).alias("body"))
    rows = nation.join(supplier, F.col("s_nationkey") % 5 == F.col("n_regionkey")).select(F.col("n_nationkey").alias("host"), F.col("s_suppkey").alias("page"), F.concat(F.lit("https://a.com/p/"), "s_suppkey").alias("url"))
    return sitemaps.judge_robots(rows, robots).drop("url")
