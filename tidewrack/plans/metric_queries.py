"""Queries for the metrics that the audit method describes. Customers are queries or reviewers, orders are pages or visits, suppliers are sites."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewrack.functions import numbers
from tidewrack.operators import grid, table
from tidewrack.plans.registry import query, read


@query("""
WITH c AS (SELECT o_orderpriority AS t, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT n, row_number() OVER (ORDER BY n DESC, t) AS p FROM c)
SELECT CAST(sum(n) FILTER (p <= 3) AS DOUBLE) / sum(n) AS value, CAST(sum(n) FILTER (p <= 3) AS DOUBLE) / sum(n) >= 0.7 AS ok FROM r""")
def theme_concentration(spark, sf_dir):
    return grid.theme_concentration(read(spark, sf_dir, "orders"), "o_orderpriority")


@query("SELECT count(*) FILTER (o_orderstatus = 'F') / CAST(count(*) AS DOUBLE) AS value, count(*) FILTER (o_orderstatus = 'F') / CAST(count(*) AS DOUBLE) <= 0.2 AS ok FROM orders")
def format_mismatch(spark, sf_dir):
    return grid.share_meeting(read(spark, sf_dir, "orders"), F.col("o_orderstatus") == "F", most=0.2)


@query("SELECT count(*) FILTER (toxic = 0) / CAST(count(*) AS DOUBLE) AS value, count(*) FILTER (toxic = 0) / CAST(count(*) AS DOUBLE) >= 0.7 AS ok FROM labels")
def answered_questions(spark, sf_dir):
    return grid.share_meeting(read(spark, sf_dir, "labels"), F.col("toxic") == 0, least=0.7)


@query("SELECT o_custkey AS query, count(*) AS n FROM orders WHERE o_totalprice > 300000 GROUP BY 1 HAVING count(*) >= 3")
def attackable_queries(spark, sf_dir):
    return grid.groups_with(read(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("query")), "query", 3)


@query("""
SELECT c_custkey AS query, 1 + c_custkey % 30 AS position FROM customer WHERE 1 + c_custkey % 30 > 10 AND c_custkey IN (SELECT o_custkey FROM orders) AND c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)""")
def hidden_queries(spark, sf_dir):
    customer = read(spark, sf_dir, "customer")
    queries = customer.select(F.col("c_custkey").alias("query"), (1 + F.col("c_custkey") % 30).alias("position"))
    suggested = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query"))
    return grid.hidden_queries(queries, suggested, customer.where("c_acctbal > 5000").select(F.col("c_custkey").alias("query")))


@query("""
SELECT l_partkey AS query, count(*) AS n, max(l_linenumber) AS depth FROM lineitem WHERE l_quantity > 48 GROUP BY 1 HAVING count(*) <> 1 OR max(l_linenumber) > 2""")
def crowded_money_queries(spark, sf_dir):
    pages = read(spark, sf_dir, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("query"), F.col("l_linenumber").alias("depth"))
    return grid.one_page_each(pages, "query", "depth")


MONEY = "SELECT s_suppkey AS id, coalesce(n, 0) AS links, s_acctbal > 6000 AS money, s_suppkey % 6 AS depth FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) ON s_suppkey = l_suppkey"


def _money(spark, sf_dir):
    links = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.count("*").alias("links"))
    pages = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") > 6000).alias("money"), (F.col("s_suppkey") % 6).alias("depth"))
    return pages.join(links, "id", "left").fillna(0, ["links"])


@query(f"""
WITH t AS (SELECT money, ntile(10) OVER (ORDER BY links DESC, id) AS tile FROM ({MONEY}))
SELECT count(*) FILTER (tile = 1) / CAST(count(*) AS DOUBLE) AS value, count(*) FILTER (tile = 1) / CAST(count(*) AS DOUBLE) >= 1 AS ok FROM t WHERE money""")
def money_pages_decile(spark, sf_dir):
    return grid.money_pages_in_top_decile(_money(spark, sf_dir).select("id", "links", "money"), "links", "money")


@query(f"""
WITH m AS ({MONEY}), v AS (SELECT count(*) FILTER (money AND depth > 3) AS deep_money_pages, CAST(count(*) FILTER (depth <= 4) AS DOUBLE) / count(depth) AS value FROM m)
SELECT deep_money_pages, value, deep_money_pages = 0 AND value >= 0.9 AS ok FROM v""")
def money_depth(spark, sf_dir):
    return grid.money_depth(_money(spark, sf_dir), "depth", "money")


@query(f"SELECT id, links FROM ({MONEY}) WHERE money AND links < 600")
def few_inbound(spark, sf_dir):
    return grid.few_inbound(_money(spark, sf_dir).where("money"), "links", least=600).select("id", "links")


@query("SELECT c_custkey AS query FROM customer WHERE c_acctbal > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def uncovered_money_queries(spark, sf_dir):
    money = read(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("query"))
    return grid.uncovered(money, read(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("query")))


@query("SELECT count(DISTINCT l_suppkey) AS value, count(DISTINCT l_suppkey) >= 50 AS ok FROM lineitem")
def enough_domains(spark, sf_dir):
    return grid.enough(read(spark, sf_dir, "lineitem"), 50, "l_suppkey")


@query("""
SELECT o_orderkey AS query, 1 + o_orderkey % 40 AS position, o_totalprice * (0.3::DOUBLE - (o_orderkey % 7) / 100.0::DOUBLE) AS gain FROM orders WHERE 1 + o_orderkey % 40 BETWEEN 11 AND 30 ORDER BY 3 DESC, 1 LIMIT 10""")
def top_expected_gain(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select(k.alias("query"), (1 + k % 40).alias("position"), F.col("o_totalprice").alias("impressions"), ((k % 7) / F.lit(100.0)).alias("rate"), F.lit(0.3).alias("expected"))
    return grid.expected_gain(rows, "impressions", "rate", "expected").select("query", "position", "gain")


@query(r"""
WITH w AS (SELECT conv_id * 1000 + turn AS id, regexp_extract_all(coalesce(text, ''), '\S+') AS w FROM conversations),
g AS (SELECT DISTINCT id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i + 1 : i + 5], ' ') END AS g FROM (SELECT id, w, unnest(range(greatest(len(w) - 4, 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT g, count(*) AS n FROM g GROUP BY 1)
SELECT id, count(*) FILTER (n = 1) / CAST(count(*) AS DOUBLE) AS value, count(*) FILTER (n = 1) / CAST(count(*) AS DOUBLE) >= 0.4 AS ok FROM g JOIN n USING (g) GROUP BY 1""")
def unique_content(spark, sf_dir):
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(\S+)"), 1)
    return grid.unique_content(read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), words.alias("words")), "id", "words")


@query("""
WITH c AS (SELECT s_suppkey AS id, s_suppkey % 5 AS k FROM supplier) SELECT id, k = 2 AS loop FROM c WHERE k IN (2, 3)""")
def redirect_chains(spark, sf_dir):
    k = F.col("s_suppkey") % 5
    chain = F.when(k == 0, F.array()).when(k == 1, F.array(F.lit("a"))).when(k == 2, F.array(F.lit("a"), F.lit("b"), F.lit("a"))).when(k == 3, F.array(F.lit("a"), F.lit("b"), F.lit("c"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    return grid.chain_faults(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), chain.cast("array<string>").alias("chain")), "chain").select("id", "loop")


@query("""
WITH d AS (SELECT date_diff('day', o_orderdate, min(l_shipdate)) AS d FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate)
SELECT quantile_cont(d, 0.5) AS value, quantile_cont(d, 0.5) <= 7 AS ok FROM d""")
def index_delay(spark, sf_dir):
    shipped = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("indexed"))
    return grid.index_delay(read(spark, sf_dir, "orders").join(shipped, "o_orderkey", "left"), "o_orderdate", "indexed")


@query("SELECT quantile_cont(date_diff('day', o_orderdate, DATE '2002-01-01'), 0.5) AS median_days FROM orders WHERE o_orderstatus = 'F'")
def conversion_delay(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").withColumn("end", F.when(F.col("o_orderstatus") == "F", F.lit("2002-01-01").cast("date")))
    return grid.conversion_delay(rows, "o_orderdate", "end")


@query("""
WITH p AS (SELECT o_orderkey % 6 AS depth, o_orderstatus <> 'P' AS indexed, o_orderpriority AS reason FROM orders), v AS (
SELECT count(*) FILTER (indexed) AS indexed, count(*) AS pages, CAST(count(*) FILTER (indexed) AS DOUBLE) / count(*) AS value, CAST(count(*) FILTER (indexed AND depth >= 4) AS DOUBLE) / count(*) FILTER (depth >= 4) AS deep_value, count(DISTINCT reason) FILTER (NOT indexed) AS reasons FROM p)
SELECT *, value >= 0.8 AND deep_value >= 0.8 AS ok FROM v""")
def index_status(spark, sf_dir):
    pages = read(spark, sf_dir, "orders").select((F.col("o_orderkey") % 6).alias("depth"), (F.col("o_orderstatus") != "P").alias("indexed"), F.col("o_orderpriority").alias("reason"))
    return grid.index_status(pages, "reason", "indexed", "depth")


@query("""
WITH c AS (SELECT o_orderdate, count(*) AS n FROM orders GROUP BY 1) SELECT CAST(max(n) AS DOUBLE) / sum(n) AS value, CAST(max(n) AS DOUBLE) / sum(n) <= 0.5 AS ok FROM c""")
def mass_updates(spark, sf_dir):
    return grid.stale_dates(read(spark, sf_dir, "orders"), "o_orderdate")


@query("""
SELECT event_type AS domain, count(*) AS n, event_type IN ('click', 'view') AS named, count(*) / CAST((SELECT count(*) FROM events) AS DOUBLE) AS share FROM events GROUP BY 1""")
def referrer_share(spark, sf_dir):
    return grid.referrer_share(read(spark, sf_dir, "events").select(F.col("event_type").alias("domain")), "domain", ["click", "view"])


@query("""
WITH s AS (SELECT quantile_cont(value, 0.5) AS site_median FROM events), m AS (SELECT event_type, quantile_cont(value, 0.5) AS median FROM events GROUP BY 1) SELECT event_type, median, site_median, median > site_median AS above FROM m, s""")
def engagement_gap(spark, sf_dir):
    return grid.engagement_gap(read(spark, sf_dir, "events").select("event_type", "value"), "event_type", "value")


@query("SELECT event_type, round(quantile_cont(value, 0.9), 9) AS q FROM events GROUP BY 1")
def value_quantiles(spark, sf_dir):
    return table.quantile(read(spark, sf_dir, "events"), ["event_type"], "value", 0.9, "q").select("event_type", F.round("q", 9).alias("q"))


@query("SELECT count(*) FILTER (quality = 1) / CAST(count(*) AS DOUBLE) AS value, count(*) FILTER (quality = 1) / CAST(count(*) AS DOUBLE) >= 0.5 AS ok FROM labels")
def reply_rate(spark, sf_dir):
    return grid.reply_rate(read(spark, sf_dir, "labels").withColumn("replied", F.col("quality") == 1), "replied")


@query("SELECT s_nationkey AS place, 1 + (count(*) > 1 AND count(DISTINCT s_suppkey % 3 = 0) > 1)::INT AS phone FROM supplier GROUP BY 1 HAVING count(DISTINCT s_suppkey % 3 = 0) > 1")
def divergent_listings(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("place"), F.when(k % 3 == 0, "01-23").when(k % 3 == 1, "(4) 5.6").otherwise("4 56").alias("phone"), F.when(k % 2 == 0, "ACME Inc").otherwise("acme inc").alias("name"))
    return grid.divergent(rows, "place", ["phone", "name"]).select("place", F.col("phone").cast("int").alias("phone"))


@query("""
WITH p AS (SELECT user_id, avg((event_type = 'click')::INT::DOUBLE) AS rate, count(*) AS runs FROM events GROUP BY 1)
SELECT round(avg(rate), 9) AS rate, round(min(rate), 9) AS lowest, round(max(rate), 9) AS highest, round(stddev_samp(rate), 9) AS spread, min(runs) AS fewest_runs FROM p""")
def citation_rate(spark, sf_dir):
    found = grid.citation_rate(read(spark, sf_dir, "events").select("user_id", (F.col("event_type") == "click").alias("cited")), "user_id", "cited")
    return found.select(F.round("rate", 9).alias("rate"), F.round("lowest", 9).alias("lowest"), F.round("highest", 9).alias("highest"), F.round("spread", 9).alias("spread"), "fewest_runs")


@query("""
SELECT s_suppkey AS url FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50 AND l_linenumber = 7) AND s_acctbal <= 5000 AND s_nationkey <> 3""")
def useless_pages(spark, sf_dir):
    supplier = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("url"), "s_acctbal", "s_nationkey")
    clicked = read(spark, sf_dir, "lineitem").where("l_quantity = 50 and l_linenumber = 7").select(F.col("l_suppkey").alias("url"))
    return grid.useless_pages(supplier, clicked, supplier.where("s_acctbal > 5000"), supplier.where("s_nationkey = 3")).select("url")


@query("""
SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 2 + p_size END AS answer_words, CASE WHEN p_partkey % 2 = 0 THEN 2 + p_size <= 40 END AS ok FROM part""")
def answer_lengths(spark, sf_dir):
    said = F.concat(F.lit("## What is it"), F.when(F.col("p_partkey") % 2 == 0, "?").otherwise("."), F.lit("\n\nIt is "), F.repeat(F.lit("so "), F.col("p_size")), F.lit("\n\nAnd more."))
    return grid.answer_length(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), said.alias("t")), "t", most=40).select("id", "answer_words", "ok")


@query("""
SELECT s_suppkey AS id, CASE WHEN b >= 0.9 THEN 5 WHEN b >= 0.7 THEN 4 WHEN b >= 0.5 THEN 3 WHEN b >= 0.3 THEN 2 WHEN b IS NOT NULL THEN 1 END AS level FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 9 <> 0 THEN (s_suppkey % 10) / 10.0::DOUBLE END AS b FROM supplier)""")
def maturity_levels(spark, sf_dir):
    k = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(k.alias("id"), grid.maturity(F.when(k % 9 != 0, (k % 10) / F.lit(10.0))).alias("level"))


@query("""
SELECT o_orderpriority AS stage, round(sum(o_totalprice), 2) AS total, sum(o_totalprice) >= 1000000 AS ok FROM orders GROUP BY 1""")
def volume_floors(spark, sf_dir):
    found = grid.floor_check(read(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "stage"), "stage", "o_totalprice", 1_000_000)
    return found.select("stage", F.round("total", 2).alias("total"), "ok")


@query("""
SELECT lang, count(DISTINCT source) AS sources, count(DISTINCT doc_id % 4) AS levels, count(DISTINCT source) >= 2 AND count(DISTINCT doc_id % 4) >= 4 AS ok FROM documents GROUP BY 1""")
def locale_coverage(spark, sf_dir):
    return grid.locale_coverage(read(spark, sf_dir, "documents").select("lang", "source", (F.col("doc_id") % 4).alias("level")), "lang", "source", "level")


@query("SELECT stage FROM (VALUES ('view'), ('click'), ('subscribe'), ('refer')) v(stage) WHERE stage NOT IN (SELECT event_type FROM events)")
def empty_stages(spark, sf_dir):
    return grid.empty_stages(read(spark, sf_dir, "events").select(F.col("event_type").alias("stage")), "stage", ["view", "click", "subscribe", "refer"])


@query("""
WITH f AS (SELECT c_custkey AS id, (c_acctbal > 0)::INT + (c_custkey % 2 = 0)::INT + (c_custkey % 3 <> 0)::INT + (c_nationkey > 5)::INT + coalesce((CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE true END)::INT, 0) AS met FROM customer)
SELECT id, met, met >= 4 AS ok FROM f""")
def criteria_met(spark, sf_dir):
    k = F.col("c_custkey")
    rows = read(spark, sf_dir, "customer").select(k.alias("id"), (F.col("c_acctbal") > 0).alias("a"), (k % 2 == 0).alias("b"), (k % 3 != 0).alias("c"), (F.col("c_nationkey") > 5).alias("d"), F.when(k % 5 != 0, F.lit(True)).alias("e"))
    return grid.criteria_met(rows, list("abcde")).select("id", "met", "ok")


@query("""
SELECT o_custkey AS entity, CAST(count(DISTINCT o_orderpriority) AS INT) AS profiles, count(DISTINCT o_orderpriority) >= 3 AS ok FROM orders GROUP BY 1""")
def entity_links(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("entity")).agg(F.collect_list("o_orderpriority").alias("same_as"))
    return grid.entity_links(rows, "entity", "same_as")


@query("""
SELECT l_orderkey AS query, min(l_linenumber) FILTER (l_suppkey % 2 = 0) AS place, coalesce(min(l_linenumber) FILTER (l_suppkey % 2 = 0) = 1, false) AS ok FROM lineitem GROUP BY 1""")
def brand_first(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query"), F.when(F.col("l_suppkey") % 2 == 0, "own").otherwise("other").alias("site"), F.col("l_linenumber").alias("position"))
    return grid.brand_first(rows, "query", "site", "own")


@query("""
WITH h AS (SELECT user_id, list(DISTINCT event_type) AS held FROM events GROUP BY 1)
SELECT user_id, array_to_string(list_sort(list_filter(['click', 'measure', 'view'], lambda x: NOT list_contains(held, x))), ',') AS missing FROM h""")
def declared_capabilities(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("capability"))
    return grid.declared_capabilities(rows, "user_id", ["click", "measure", "view"]).select("user_id", F.array_join("missing", ",").alias("missing"))


@query("""
WITH m AS (SELECT date_trunc('month', o_orderdate) AS month, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1),
w AS (SELECT *, avg(n) OVER p AS mean, stddev_samp(n) OVER p AS sd, count(*) OVER p AS c FROM m WINDOW p AS (ORDER BY month ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING))
SELECT CAST(CAST(month AS DATE) AS VARCHAR) AS month, CASE WHEN c >= 6 THEN abs(n - mean) > 2 * sd END AS is_break FROM w""")
def series_breaks(spark, sf_dir):
    months = read(spark, sf_dir, "orders").groupBy(F.trunc("o_orderdate", "month").alias("month")).agg(F.count("*").cast("double").alias("n"))
    return table.breaks(months, "month", "n", sigmas=2.0).select(F.col("month").cast("string").alias("month"), "is_break")


@query("""
WITH m AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) AS x, count(*) AS y FROM orders GROUP BY 1) SELECT round(regr_slope(y, x), 9) AS slope, count(*) AS n FROM m""")
def series_trend(spark, sf_dir):
    months = read(spark, sf_dir, "orders").groupBy((F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("x")).agg(F.count("*").alias("y"))
    return table.trend(months, "x", "y").select(F.round("slope", 9).alias("slope"), "n")


@query("SELECT o_orderkey AS id, o_totalprice * (0.05::DOUBLE - (o_orderkey % 5) / 100.0::DOUBLE) AS clicks FROM orders")
def target_clicks(spark, sf_dir):
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(k.alias("id"), numbers.target_clicks(F.col("o_totalprice"), (k % 5) / F.lit(100.0), F.lit(0.05)).alias("clicks"))


@query("""
SELECT s_name, s_acctbal FROM supplier ORDER BY s_nationkey, s_acctbal DESC NULLS LAST, s_name LIMIT 12""")
def page_sort_top(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier").withColumn("shown", F.format_string("%.2f EUR", "s_acctbal"))
    return table.sort(rows, "shown", numeric=True, descending=True, group="s_nationkey", key="s_name").limit(12).select("s_name", "s_acctbal")


@query("SELECT c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 1")
def filter_values(spark, sf_dir):
    return table.filter_values(read(spark, sf_dir, "customer"), "c_mktsegment")
