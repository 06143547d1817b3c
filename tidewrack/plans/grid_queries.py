"""Queries for grid metrics over crawls, sitemaps, markup and links, and for registries that are read from given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewrack.operators import graph, grid, logs, migrate, rules, study
from tidewrack.plans.registry import query, read
from tidewrack.session import shared_folder
from tidewrack.sources import documents, pages

EDGES = "SELECT DISTINCT l_suppkey AS src, 2 * ((l_suppkey + l_linenumber % 3) % ((SELECT count(*) FROM supplier) // 2)) AS dst FROM lineitem"


@query(f"""
WITH RECURSIVE e AS ({EDGES}), w(node, depth) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node WHERE w.depth < (SELECT count(*) FROM supplier)),
d AS (SELECT node, min(depth) AS depth FROM w GROUP BY 1), p AS (SELECT s_suppkey AS k, 'page' || s_nationkey % 4 AS template, depth, s_acctbal > 0 AS indexable FROM supplier LEFT JOIN d ON node = s_suppkey),
h AS (SELECT event_type AS agent, user_id % (SELECT count(*) + 20 FROM supplier) AS k, count(*) AS n FROM events GROUP BY 1, 2)
SELECT agent, template, depth, CAST(sum(n) AS BIGINT) AS hits, count(*) AS pages_hit, CAST(coalesce(sum(n) FILTER (NOT indexable), 0) AS BIGINT) AS wasted FROM h LEFT JOIN p USING (k) GROUP BY 1, 2, 3""")
def crawler_hits(spark, sf_dir):
    """Hits of each agent by type and click depth of the page."""
    supplier, lineitem = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "lineitem")
    n = supplier.count()
    edges = lineitem.select(F.col("l_suppkey").alias("src"), (2 * ((F.col("l_suppkey") + F.col("l_linenumber") % 3) % (n // 2))).alias("dst")).distinct()
    depth = graph.click_depth(edges, spark.createDataFrame([(0,)], "node long")).withColumnRenamed("node", "url")
    known = supplier.select(F.col("s_suppkey").alias("url"), F.concat(F.lit("page"), (F.col("s_nationkey") % 4).cast("string")).alias("template"), (F.col("s_acctbal") > 0).alias("indexable")).join(depth, "url", "left")
    hits = read(spark, sf_dir, "events").select(F.col("event_type").alias("agent"), (F.col("user_id") % (n + 20)).alias("url"))
    return grid.crawler_hits(hits, known)


@query("""
WITH p AS (SELECT page_id, 'page' || page_id % 3 AS template, CASE WHEN page_id % 3 = 0 THEN 1 WHEN page_id % 3 = 1 AND length(coalesce(html, '')) % 2 = 0 THEN 1 ELSE 0 END AS blocks, CASE WHEN page_id % 3 = 2 AND length(coalesce(html, '')) % 5 = 0 THEN 1 ELSE 0 END AS errors FROM pages),
f AS (SELECT template, count(*) AS n, count(*) FILTER (blocks > 0) AS m, CAST(sum(errors) AS BIGINT) AS e FROM p GROUP BY 1)
SELECT t.template, coalesce(n, 0) AS pages, coalesce(m, 0) AS marked, coalesce(e, 0) AS errors, m / CAST(n AS DOUBLE) AS value, m = n AND e = 0 AS ok FROM (VALUES ('page0'), ('page1'), ('page2'), ('page9')) t(template) LEFT JOIN f USING (template)""")
def markup_by_template(spark, sf_dir):
    """Pages with a block of structured data in their head, whole, broken or none, by type."""
    k, size = F.col("page_id") % 3, F.char_length(F.coalesce("html", F.lit("")))
    block = F.when((k == 0) | ((k == 1) & (size % 2 == 0)), '<script type="application/ld+json">{"@type": "Article"}</script>').when((k == 2) & (size % 5 == 0), '<script type="application/ld+json">{broken</script>').otherwise("")
    rows = read(spark, sf_dir, "pages").select("page_id", F.concat(block, F.coalesce("html", F.lit(""))).alias("html"))
    found = pages.extract(rows, "page_id")
    return grid.markup_by_template(found.select(F.concat(F.lit("page"), (F.col("page_id") % 3).cast("string")).alias("template"), F.size("json_ld").alias("blocks"), F.size("json_ld_errors").alias("errors")), ["page0", "page1", "page2", "page9"])


@query("""
WITH p AS (SELECT CASE WHEN c_custkey % 50 = 7 THEN NULL WHEN c_custkey % 40 = 3 THEN 404 ELSE 200 END AS status, c_acctbal < -900 AS noindex, c_nationkey = c_custkey % 25 AS away, c_custkey % 20 > 0 AS inside, c_acctbal > 0 AS valued FROM customer)
SELECT count(*) FILTER (inside) AS declared, count(*) FILTER (inside AND status <> 200) AS not_200, count(*) FILTER (inside AND noindex) AS noindex, count(*) FILTER (inside AND away) AS canonical_away, count(*) FILTER (inside AND status IS NULL) AS not_seen,
  count(*) FILTER (inside AND valued) / CAST(count(*) FILTER (valued) AS DOUBLE) AS present, count(*) FILTER (inside AND (status <> 200 OR noindex OR away)) = 0 AND count(*) FILTER (inside AND valued) / CAST(count(*) FILTER (valued) AS DOUBLE) >= 0.95 AS ok FROM p""")
def sitemap_health(spark, sf_dir):
    k = F.col("c_custkey")
    rows = read(spark, sf_dir, "customer").select(k.alias("url"), F.when(k % 50 == 7, F.lit(None).cast("int")).when(k % 40 == 3, 404).otherwise(200).alias("status"), (F.col("c_acctbal") < -900).alias("noindex"), (F.col("c_nationkey") == k % 25).alias("away"), (k % 20 > 0).alias("in_sitemap"), (F.col("c_acctbal") > 0).alias("valued"))
    return grid.sitemap_health(rows)


@query("""
WITH c AS (SELECT n_nationkey AS host, s_suppkey AS k, s_acctbal AS b FROM nation JOIN supplier ON s_nationkey = n_nationkey),
f AS (SELECT host, count(*) AS cited, count(*) FILTER (k % 10 <> 3 AND b > -500) AS answering, count(*) FILTER (k % 10 = 3) AS unseen, count(*) FILTER (k % 4 = 1) AS undeclared FROM c GROUP BY 1)
SELECT n_nationkey AS host, coalesce(cited, 0) AS cited, coalesce(answering, 0) AS answering, coalesce(unseen, 0) AS unseen, coalesce(undeclared, 0) AS undeclared, coalesce(answering + unseen = cited AND undeclared = 0, true) AS ok FROM nation LEFT JOIN f ON host = n_nationkey""")
def directive_urls(spark, sf_dir):
    """Directive files that cite the suppliers of a nation, held against answers and a sitemap."""
    supplier, nation = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation")
    url = F.concat(F.lit("https://a.com/s/"), F.col("s_suppkey").cast("string"))
    lines = supplier.groupBy("s_nationkey").agg(F.concat_ws("\n", F.collect_list(F.concat(F.lit("- [name]("), url, F.lit("): see "), url, F.lit(".")))).alias("lines"))
    files = nation.join(lines, F.col("n_nationkey") == F.col("s_nationkey"), "left").select(F.col("n_nationkey").alias("host"), F.concat(F.lit("# Site\n"), F.coalesce("lines", F.lit(""))).alias("body"))
    answers = supplier.where("s_suppkey % 10 <> 3").select(url.alias("url"), F.when(F.col("s_acctbal") > -500, 200).otherwise(404).alias("status"))
    return grid.directive_urls(files, answers, supplier.where("s_suppkey % 4 <> 1").select(url.alias("url")))


@query("""
WITH c AS (SELECT 80 + p_size % 5 AS node, p_brand AS name FROM part WHERE p_retailprice > 1500 AND p_partkey % 3 <> 0)
SELECT CAST(v.node AS INT) AS node, count(DISTINCT name) AS n, CAST(least AS INT) AS least, count(DISTINCT name) >= least AS ok FROM (VALUES (80, 2), (83, 5), (84, 3), (99, 1)) v(node, least) LEFT JOIN c ON c.node = v.node GROUP BY v.node, least""")
def strategy_minimums(spark, sf_dir):
    """Candidates of a judgement that have both of their qualities, against its minimum."""
    rows = read(spark, sf_dir, "part").select((80 + F.col("p_size") % 5).cast("int").alias("node"), F.col("p_brand").alias("name"), F.when(F.col("p_retailprice") > 1500, "legitimate").alias("legitimacy"), F.when(F.col("p_partkey") % 3 == 0, " ").otherwise("seen").alias("results"))
    return grid.minimum_counts(rows, {80: 2, 83: 5, 84: 3, 99: 1}, ["legitimacy", "results"])


@query("SELECT p_partkey AS id FROM part WHERE p_size % 4 NOT IN (1, 2)")
def unjustified_sites(spark, sf_dir):
    reason = F.when(F.col("p_size") % 4 == 1, "brand").when(F.col("p_size") % 4 == 2, "language").when(F.col("p_size") % 4 == 3, "authority")
    return grid.unjustified(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), reason.alias("reason")), "reason", ["brand", "language", "model"]).select("id")


@query("""
SELECT l_returnflag AS channel, CAST(count(*) * 10 AS BIGINT) AS spent, CAST(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS leads, CASE WHEN sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) > 0 THEN count(*) * 10 / CAST(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS DOUBLE) END AS value FROM lineitem GROUP BY 1""")
def lead_costs(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("channel"), F.lit(10).alias("spent"), (F.col("l_linestatus") == "F").cast("int").alias("leads"))
    return grid.lead_cost(rows, "channel", "spent", "leads")


@query("""
SELECT c_mktsegment AS segment, count(DISTINCT c_custkey) AS customers, sum(o_orderkey % 100) / CAST(count(*) AS DOUBLE) AS basket, count(*) / CAST(count(DISTINCT c_custkey) AS DOUBLE) AS recurrence, sum(o_orderkey % 100) / CAST(count(DISTINCT c_custkey) AS DOUBLE) AS value
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1""")
def customer_values(spark, sf_dir):
    sales = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("segment"), "c_custkey", (F.col("o_orderkey") % 100).alias("amount"))
    return grid.customer_value(sales, "segment", "c_custkey", "amount")


LINKED = "SELECT DISTINCT 'n' || s_nationkey AS site, l_partkey AS domain FROM lineitem JOIN supplier ON s_suppkey = l_suppkey"


def _links(spark, sf_dir):
    met = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return met.select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("site"), F.col("l_partkey").alias("domain"))


@query(f"WITH l AS ({LINKED}) SELECT domain, count(*) AS competitors FROM l WHERE site <> 'n3' AND domain NOT IN (SELECT domain FROM l WHERE site = 'n3') GROUP BY 1")
def link_gaps(spark, sf_dir):
    return grid.link_gap(_links(spark, sf_dir), "n3")


@query(f"""
WITH c AS (SELECT site, count(*) AS n FROM ({LINKED}) GROUP BY 1)
SELECT coalesce(max(n) FILTER (site = 'n3'), 0) AS own, count(*) FILTER (site <> 'n3') AS competitors, median(n) FILTER (site <> 'n3') AS median, max(n) FILTER (site <> 'n3') AS best, coalesce(max(n) FILTER (site = 'n3'), 0) >= median(n) FILTER (site <> 'n3') AS ok FROM c""")
def domains_against(spark, sf_dir):
    return grid.domains_against(_links(spark, sf_dir), "n3")


# --- registries ------------------------------------------------------------------------------------------------


@query("""
WITH RECURSIVE a AS (SELECT DISTINCT n_nationkey AS de, n_nationkey + n_regionkey + 1 AS vers FROM nation), w(v, hops, path) AS (SELECT CAST(0 AS BIGINT), 0, ['v00'] UNION ALL SELECT a.vers, hops + 1, list_append(path, printf('v%02d', a.vers)) FROM w JOIN a ON a.de = w.v)
SELECT printf('v%02d', v) AS version, hops, array_to_string(min(path), '>') AS path FROM (SELECT *, min(hops) OVER (PARTITION BY v) AS least FROM w) WHERE hops = least GROUP BY v, hops""")
def version_chains(spark, sf_dir):
    """Shortest chains of versions, an evolution for each nation."""
    version = lambda c: F.concat(F.lit("v"), F.lpad(c.cast("string"), 2, "0"))
    arcs = read(spark, sf_dir, "nation").select(version(F.col("n_nationkey")).alias("de"), version(F.col("n_nationkey") + F.col("n_regionkey") + 1).alias("vers"))
    return migrate.chains(arcs, "v00").select("version", "hops", F.array_join("path", ">").alias("path"))


@query("""
SELECT 'v' || n_nationkey AS de, 'v' || (n_nationkey + 1) AS vers, n_name AS motif, CAST(n_nationkey + n_regionkey AS INT) AS moved, CAST(n_regionkey AS INT) AS retired FROM nation""")
def evolutions_of_nations(spark, sf_dir):
    """A registry file with an evolution for each nation, written and read back."""
    k = F.col("n_nationkey")
    one = F.struct(F.concat(F.lit("v"), k).alias("de"), F.concat(F.lit("v"), k + 1).alias("vers"), F.lit("2026-01-01").alias("date"), F.col("n_name").alias("motif"), F.create_map(k.cast("string"), (k + F.col("n_regionkey")).cast("int")).alias("correspondances"), F.array(F.col("n_regionkey").cast("int")).alias("identifiants_retires"), F.array().cast("array<int>").alias("identifiants_nouveaux"))
    registry = read(spark, sf_dir, "nation").agg(F.to_json(F.struct(F.lit("v25").alias("version_courante"), F.collect_list(one).alias("evolutions"))).alias("value"))  # 25 nations
    path = f"{shared_folder(spark)}/registry-{uuid.uuid4().hex}"
    registry.write.text(path)
    found = documents.evolution_registry(spark, path)
    return found.select("de", "vers", "motif", F.map_values("correspondances")[0].alias("moved"), F.col("identifiants_retires")[0].alias("retired"))


@query("""
SELECT 'logs ' || c_custkey AS source, 'non-mesurable' AS verdict, CAST(NULL AS BIGINT) AS read, CAST(NULL AS BIGINT) AS recognised, CAST(NULL AS BIGINT) AS ignored, 'access log' AS missing, 'give one' AS remedy FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def customers_without_logs(spark, sf_dir):
    """Customers without a pending order, as sources whose measure is missing."""
    named = lambda c: F.concat(F.lit("logs "), F.col(c).cast("string")).alias("source")
    return logs.unmeasured(read(spark, sf_dir, "customer").select(named("c_custkey")), read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(named("o_custkey")), "access log", "give one")


@query("""
SELECT c_nationkey AS nation, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS INT) AS position, CAST(c_custkey AS VARCHAR) AS id, c_name AS name FROM customer""")
def content_lists(spark, sf_dir):
    """Content in the form of lists, one for each nation, in their order."""
    item = F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    lists = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("body"))
    found = study.content_list(lists)
    return found.select(F.col("fields")["nation"].cast("long").alias("nation"), "position", "id", F.col("fields")["name"].alias("name"))


READING = "CASE WHEN o_orderstatus = 'P' THEN 'export ' ELSE 'Connecteur, ' END || CASE WHEN o_totalprice > 200000 THEN 'lue le ' ELSE 'vu le ' END || CAST(o_orderdate AS STRING) || CASE WHEN o_orderkey % 5 > 1 THEN ', du ' || CAST(o_orderdate AS STRING) || ' au 2026-01-01' ELSE '' END"


@query(rf"""
WITH s AS (SELECT o_orderkey AS id, CASE WHEN o_orderpriority < '3' THEN 'T1' ELSE 'T2' END AS tier, {READING.replace("STRING", "VARCHAR")} AS s FROM orders)
SELECT id, CASE WHEN contains(lower(s), 'connecteur') THEN concat_ws(';', CASE WHEN tier <> 'T1' THEN 'tier is not T1' END, CASE WHEN NOT regexp_matches(s, '(?i)\blue?\s+le\s+\d{{4}}-\d{{2}}-\d{{2}}\b') THEN 'no read date' END,
  CASE WHEN len(regexp_extract_all(s, '\b\d{{4}}-\d{{2}}-\d{{2}}\b')) < 3 THEN 'no period' END) ELSE '' END AS violations FROM s""")
def dated_readings(spark, sf_dir):
    """Metrics whose sources say in words of the table who read them, when and for which period."""
    orders = read(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
    rows = orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderpriority") < "3", "T1").otherwise("T2").alias("preuve"), F.expr(READING).alias("source"))
    return rules.connector_metrics(rows).select("id", F.array_join("violations", ";").alias("violations"))
