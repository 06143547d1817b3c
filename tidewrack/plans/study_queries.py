"""Queries over a study: sheets, actions, snapshots, versions and the checks they must pass. Parts are nodes, orders are actions and runs."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from tidewrack.functions import numbers, text
from tidewrack.operators import checks, migrate, rules, scoring, sinks, snapshot, study, table
from tidewrack.plans.registry import query, read
from tidewrack.session import shared_folder
from tidewrack.sources import documents
from tidewrack.sources import logs as log_lines

# --- sheets ----------------------------------------------------------------------------------------------------


def _sheets(spark, sf_dir):
    """A sheet for each customer: front matter, two sections and a table."""
    k = F.col("c_custkey").cast("string")
    body = F.concat(
        F.lit("---\n# a comment\nid: "), k, F.lit("\netat: "), F.element_at(F.array(*map(F.lit, snapshot.STATES)), (F.col("c_custkey") % 4 + 1).cast("int")), F.lit("\nnote: a: b\n---\n## Constat\n<!-- hidden -->\nSeen "), k, F.lit(" times.\n"),
        F.when(F.col("c_custkey") % 3 == 0, "").otherwise("\nMore.\n"), F.lit("\n## Preuves\n"), F.when(F.col("c_custkey") % 5 == 0, "").otherwise("`x.csv`"), F.lit("\n"),
    )
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), body.alias("text"))


@query("""
SELECT c_custkey AS id, CAST(c_custkey AS VARCHAR) AS front_id, ['a-faire', 'en-cours', 'fait', 'hors-perimetre'][c_custkey % 4 + 1] AS etat, 'a: b' AS note,
  'Seen ' || c_custkey || ' times.' || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE chr(10) || chr(10) || 'More.' END AS constat, CASE WHEN c_custkey % 5 <> 0 THEN '`x.csv`' END AS preuves FROM customer""")
def sheet_fields(spark, sf_dir):
    front = documents.front_matter(F.col("text"))
    return _sheets(spark, sf_dir).select("id", front["id"].alias("front_id"), front["etat"].alias("etat"), front["note"].alias("note"), documents.section(F.col("text"), "Constat").alias("constat"), documents.section(F.col("text"), "Preuves").alias("preuves"))


@query("""
SELECT CASE WHEN p_size % 2 = 0 THEN 'Even' ELSE 'Odd' END AS section, CAST(p_size AS VARCHAR) AS place, p_brand AS brand, count(*) AS n FROM (SELECT DISTINCT p_size, p_brand FROM part) GROUP BY ALL""")
def sheet_tables(spark, sf_dir):
    row = F.concat(F.lit("| "), F.col("p_size").cast("string"), F.lit(" | "), "p_brand", F.lit(" |"))
    lines = read(spark, sf_dir, "part").select("p_size", "p_brand").distinct().groupBy((F.col("p_size") % 2).alias("odd"), "p_brand").agg(F.array_join(F.array_sort(F.collect_list(row)), "\n").alias("rows"))
    body = F.concat(F.when(F.col("odd") == 0, "## 1. Even — x\n").otherwise("## 2. Odd -- y\n"), F.lit("| n | brand |\n|---|---|\n"), "rows")
    found = documents.table_rows(lines.select(body.alias("text")), "text", 2)
    return found.groupBy("section", F.col("cells")[0].alias("place"), F.col("cells")[1].alias("brand")).agg(F.count("*").alias("n"))


@query("""
WITH m AS (SELECT event_type AS metric, count(*) AS n, count(*) FILTER (event_id % 2 = 0) AS good, count(*) FILTER (event_id % 4 = 1) AS mid FROM events GROUP BY 1)
SELECT metric, CAST(n AS VARCHAR) AS p75, CAST(n AS DOUBLE) AS p75_number, CAST(good AS DOUBLE) AS good, CAST(mid AS DOUBLE) AS needs_improvement, 0.5::DOUBLE AS poor FROM m""")
def field_records(spark, sf_dir):
    m = read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("event_id") % 2 == 0).alias("good"), F.count_if(F.col("event_id") % 4 == 1).alias("mid"))
    body = F.concat(F.lit('{"record": {"key": {"url": "u"}, "metrics": {"'), "event_type", F.lit('": {"histogram": [{"start": 0, "end": 1, "density": '), "good", F.lit('}, {"density": '), "mid", F.lit('}, {"density": 0.5}], "percentiles": {"p75": '), F.when(F.col("n") % 2 == 0, F.concat(F.lit('"'), "n", F.lit('"'))).otherwise(F.col("n").cast("string")), F.lit("}}}}}"))
    records = m.select(body.alias("body")).unionByName(spark.createDataFrame([('{"error": {"code": 404}}',)], "body string"))
    return documents.field_metrics(records)


@query("""
SELECT s_suppkey AS id, '/site/d' || s_nationkey || '/run-' || s_suppkey % 3 || '.json' AS path, 'run-' || s_suppkey % 3 || '.json' AS name, count(*) OVER (PARTITION BY s_suppkey % 3) AS copies FROM supplier WHERE s_suppkey % 5 <> 0 AND s_nationkey % 7 <> 0""")
def discovered_files(spark, sf_dir):
    k = F.col("s_suppkey")
    name = F.concat(F.lit("run-"), k % 3, F.when(k % 5 == 0, ".txt").otherwise(".json"))
    path = F.concat(F.when(F.col("s_nationkey") % 7 == 0, "/site/old/d").otherwise("/site/d"), "s_nationkey", F.lit("/"), name)
    files = read(spark, sf_dir, "supplier").select(path.alias("path"), k.alias("id"))
    return documents.discover(files, r"^run-.*\.json$", ("old",)).join(files.distinct(), "path").select("id", "path", "name", "copies").distinct()


# --- states and evidence ---------------------------------------------------------------------------------------

SHEET_SQL = """
SELECT p_partkey AS id, p_partkey % 3 = 0 AS found, ['conforme', 'partiel', 'non-conforme', 'non-mesure'][p_partkey % 4 + 1] AS verdict, ['SD', 'PY', 'EX', 'RV', 'NM'][p_partkey % 5 + 1] AS status,
  CASE WHEN p_partkey % 7 = 0 THEN 'hors-perimetre' END AS previous, p_partkey % 2 = 0 AS needs, p_partkey % 11 < 5 AS has FROM part"""


def _nodes(spark, sf_dir):
    k = F.col("p_partkey")
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (k % len(x) + 1).cast("int"))
    return read(spark, sf_dir, "part").select(k.alias("id"), (k % 3 == 0).alias("found"), pick("conforme", "partiel", "non-conforme", "non-mesure").alias("verdict"), pick("SD", "PY", "EX", "RV", "NM").alias("status"), F.when(k % 7 == 0, "hors-perimetre").alias("previous"), (k % 2 == 0).alias("needs"), (k % 11 < 5).alias("has"))


@query(f"""
WITH s AS ({SHEET_SQL}), t AS (SELECT *, CASE WHEN found THEN 'fait' WHEN previous = 'hors-perimetre' OR status IN ('PY', 'NM', 'EX', 'RV') THEN 'hors-perimetre' ELSE 'a-faire' END AS etat FROM s)
SELECT id, etat, CASE WHEN found THEN CASE WHEN needs AND verdict <> 'non-mesure' AND NOT has THEN 'non-mesure' ELSE verdict END WHEN etat = 'hors-perimetre' THEN 'sans-objet' END AS verdict FROM t""")
def sheet_states(spark, sf_dir):
    state, verdict = snapshot.sheet_state(*[F.col(c) for c in ("found", "verdict", "status", "previous", "needs", "has")])
    return _nodes(spark, sf_dir).select("id", state.alias("etat"), verdict.alias("verdict"))


REASONS = ("Modèle d'acquisition : sans objet", "pas d'outil", None)


@query(f"""
WITH s AS ({SHEET_SQL}), n AS (SELECT id, CASE WHEN previous IS NOT NULL OR status IN ('PY', 'EX') THEN 'hors-perimetre' WHEN found THEN 'fait' WHEN id % 2 = 0 THEN 'en-cours' END AS etat, CASE id % 3 WHEN 0 THEN 'Modèle d''acquisition : sans objet' WHEN 1 THEN 'pas d''outil' END AS reason, status FROM s)
SELECT id, coalesce(etat, 'a-faire') IN ('a-faire', 'en-cours') AS open, coalesce(etat = 'hors-perimetre' AND id % 3 = 0, etat = 'hors-perimetre', false) AS out_of_model, etat IS NOT DISTINCT FROM 'hors-perimetre' AND id % 3 <> 0 AND status <> 'RV' AS debt, status = 'RV' AS crux, status = 'NM' AS unstable FROM n""")
def sheet_predicates(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    reason = F.when(F.col("id") % 3 == 0, REASONS[0]).when(F.col("id") % 3 == 1, REASONS[1])
    etat = F.when(F.col("previous").isNotNull() | F.col("status").isin("PY", "EX"), "hors-perimetre").when(F.col("found"), "fait").when(F.col("id") % 2 == 0, "en-cours")
    rows = nodes.select("id", etat.alias("etat"), reason.alias("motif_hors_perimetre"), F.col("status").alias("statut_instrumentation"), F.when(F.col("status") == "RV", "Export CrUX").alias("source"), F.when(F.col("status") == "NM", "Non reproductible").alias("reserve"))
    debt = snapshot.instrumentation_debt(rows).select("id", F.lit(True).alias("debt"))
    out = F.coalesce(snapshot.out_of_model(F.col("etat"), F.col("motif_hors_perimetre")), F.lit(False))
    return rows.join(debt, "id", "left").select("id", snapshot.not_instructed(F.col("etat")).alias("open"), out.alias("out_of_model"), F.coalesce("debt", F.lit(False)).alias("debt"), snapshot.needs_field_data(F.col("source")).alias("crux"), snapshot.not_reproducible(F.col("reserve")).alias("unstable"))


@query("""
SELECT p_brand AS branche, count(*) FILTER (p_size % 5 IN (0, 4)) AS a_faire, count(*) FILTER (p_size % 5 = 1) AS en_cours, count(*) FILTER (p_size % 5 = 2) AS fait, count(*) FILTER (p_size % 5 = 3) AS hors_perimetre, count(*) AS total FROM part GROUP BY 1""")
def states_by_branch(spark, sf_dir):
    state = F.element_at(F.array(*map(F.lit, snapshot.STATES), F.lit(None).cast("string")), (F.col("p_size") % 5 + 1).cast("int"))
    return study.states_by(read(spark, sf_dir, "part").select(F.col("p_brand").alias("branche"), state.alias("etat")), "branche")


@query("""
SELECT p_partkey AS id, CASE WHEN p_size BETWEEN 10 AND 19 THEN CASE WHEN p_size = 15 THEN 'local,saas' ELSE 'local' END WHEN p_size = 30 THEN 'saas' ELSE 'b2b-lead-gen,e-commerce,local,media-affiliation,saas' END AS modeles, p_size BETWEEN 10 AND 19 OR NOT p_size = 30 AS local FROM part""")
def node_models(spark, sf_dir):
    scopes = spark.createDataFrame([(10, 19, ["local"]), (15, 15, ["saas", "local"]), (30, 30, ["saas"])], "lo int, hi int, modeles array<string>")
    found = study.models_of(read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("id")), scopes)
    return found.select(F.col("p_partkey").alias("id"), F.array_join("modeles", ",").alias("modeles"), study.in_model(F.col("modeles"), "local").alias("local"))


@query("""
SELECT p_partkey AS id, '{"id":' || p_partkey || CASE WHEN p_size % 3 <> 0 THEN ',"verdict":"' || p_brand || '"' ELSE '' END || '}' AS body, CASE WHEN p_size % 2 = 0 THEN 'chemin' ELSE '' END AS missing FROM part""")
def node_bodies(spark, sf_dir):
    nodes = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 3 != 0, F.col("p_brand")).alias("verdict"), F.when(F.col("p_size") % 2 != 0, F.lit("x")).alias("chemin"))
    found = study.node_projection(nodes, ["id", "chemin"], ["verdict", "absent"])
    plain = F.regexp_replace("body", ',"chemin":"x"', "")
    return found.select(F.get_json_object("body", "$.id").cast("long").alias("id"), plain.alias("body"), F.array_join("missing", ",").alias("missing"))


@query("""
SELECT p_partkey AS id, p_brand AS branche, CASE WHEN p_partkey % 4 = 0 THEN coalesce(CASE WHEN p_partkey % 8 = 0 THEN 'new' END, 'old') END AS verdict FROM part WHERE p_partkey % 4 = 0""")
def sheets_on_nodes(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    nodes = part.select(F.col("p_partkey").cast("string").alias("chemin"), F.col("p_partkey").alias("id"), F.col("p_brand").alias("branche"), F.lit("old").alias("verdict"))
    sheets = part.where("p_partkey % 4 = 0").select(F.col("p_partkey").cast("string").alias("chemin"), F.lit(-1).cast("long").alias("id"), F.when(F.col("p_partkey") % 8 == 0, "new").alias("verdict"))
    return study.with_sheets(nodes, sheets).select("id", "branche", "verdict")


@query("""
SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 1 THEN 'c' || (p_partkey - 1) WHEN p_partkey % 3 = 0 THEN 'c' || p_partkey END AS constat FROM part""")
def carried_findings(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    name = lambda k: F.concat(F.lit("Node "), k.cast("string"))
    nodes = part.select(F.col("p_partkey").alias("id"), F.lit(" Branch ").alias("branche"), name(F.col("p_partkey")).alias("noeud"))
    earlier = part.where("p_partkey % 3 = 0 or p_partkey % 10 = 0").select(F.lit("BRANCH").alias("branche"), F.upper(F.concat(F.when((F.col("p_partkey") % 3 != 0), "gone ").otherwise(""), name(F.col("p_partkey")))).alias("noeud"), F.concat(F.lit("c"), "p_partkey").alias("constat"), F.lit("v").alias("verdict"))
    moves = part.where("p_partkey % 10 = 1").select(F.lit("branch").alias("branche"), name(F.col("p_partkey")).alias("noeud"), F.lit("branch").alias("old_branche"), F.concat(F.when((F.col("p_partkey") - 1) % 3 != 0, "gone ").otherwise(""), name(F.col("p_partkey") - 1)).alias("old_noeud"))
    return study.carry_over(nodes, earlier, moves).select("id", "constat")


@query("""
SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 3 END AS items, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS DOUBLE) + 4.5 END AS total, CASE WHEN p_partkey % 2 = 0 THEN 10.0::DOUBLE END AS lowest, CASE WHEN p_partkey % 2 = 0 THEN 20.0::DOUBLE END AS highest FROM part""")
def list_readings(spark, sf_dir):
    listed = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("a "), "p_size", F.lit(" x 10 ; b 4,5 x 20; c"))).otherwise("one; two")
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), study.reading(listed).alias("r")).select("id", "r.items", "r.total", "r.lowest", "r.highest")


@query("""
SELECT p_partkey AS id, 'x' || p_size AS content FROM part""")
def content_modules(spark, sf_dir):
    body = F.concat(F.lit('{"'), "p_partkey", F.lit('": "x'), "p_size", F.lit('"}'))
    return study.content_rows(read(spark, sf_dir, "part").select(body.alias("body"))).select(F.col("id").cast("long").alias("id"), "content")


# --- actions ---------------------------------------------------------------------------------------------------


def _actions(spark, sf_dir):
    k = F.col("o_orderkey")
    given = {
        "id": k.cast("string"), "volet": F.when(k % 11 == 0, "AUTRE").otherwise("ETAT"), "noeuds_couverts": F.when(k % 13 == 0, "none").otherwise("43 19"), "gain": F.when(k % 17 == 0, "6").otherwise("4"), "confiance": F.lit("4"), "effort": F.lit("2"),
        "horizon": F.when(k % 19 == 0, "quick win").otherwise("quick-win"), "axe_execution": F.lit("IA"), "regime_automatisation": F.lit("bout-en-bout"), "axe_cout": F.lit("GRATUIT"), "cout_eur": F.when(k % 23 == 0, " ").otherwise("0"),
        "dependance_de": F.when(k % 29 == 0, "nowhere").when(k % 2 == 0, F.lit("1")),
    }
    return read(spark, sf_dir, "orders").select(*[given.get(c, F.lit("x")).alias(c) for c in (*scoring.REQUIRED, "dependance_de")])


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 23 = 0 THEN 'missing: cout_eur' ELSE concat_ws('; ', CASE WHEN o_orderkey % 17 = 0 THEN 'gain is not between 1 and 5: 6' END, CASE WHEN o_orderkey % 11 = 0 THEN 'volet is not in its vocabulary: AUTRE' END,
  CASE WHEN o_orderkey % 19 = 0 THEN 'horizon is not in its vocabulary: quick win' END, CASE WHEN o_orderkey % 13 = 0 THEN 'no node is covered' END, CASE WHEN o_orderkey % 29 = 0 THEN 'unknown dependency: nowhere' END) END AS violations FROM orders""")
def action_violations(spark, sf_dir):
    return scoring.violations(_actions(spark, sf_dir)).select("id", F.array_join("violations", "; ").alias("violations"))


@query("SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def repeated_action_ids(spark, sf_dir):
    return scoring.duplicate_ids(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")))


SCORED = "SELECT o_orderkey AS id, round_even((1 + o_orderkey % 5) * CAST(left(o_orderpriority, 1) AS INT) / CAST(1 + o_custkey % 5 AS DOUBLE), 2) AS score FROM orders"


def _scored(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (1 + F.col("o_orderkey") % 5).alias("gain"), F.substring("o_orderpriority", 1, 1).cast("int").alias("confiance"), (1 + F.col("o_custkey") % 5).alias("effort"))


@query(f"SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS place FROM ({SCORED})")
def scored_places(spark, sf_dir):
    return scoring.scored(_scored(spark, sf_dir), "id").select("id", "score", "place")


@query(f"SELECT id, score FROM ({SCORED}) ORDER BY score DESC, id LIMIT 40")
def shown_actions(spark, sf_dir):
    return scoring.shown_actions(_scored(spark, sf_dir).withColumn("score", scoring.score(F.col("gain"), F.col("confiance"), F.col("effort")))).select("id", "score")


@query(f"""
WITH RECURSIVE s AS ({SCORED}), e AS (SELECT id AS src, id // 2 AS dst FROM s), w(node) AS (SELECT e.dst FROM e JOIN s ON e.src = s.id WHERE score >= 6 UNION SELECT e.dst FROM w JOIN e ON e.src = w.node)
SELECT s.id, CASE WHEN score >= 6 OR id IN (SELECT node FROM w) THEN 'do' WHEN score >= 2 THEN 'watch' ELSE 'drop' END AS band FROM s""")
def lifted_bands(spark, sf_dir):
    rows = _scored(spark, sf_dir).withColumn("score", scoring.score(F.col("gain"), F.col("confiance"), F.col("effort")))
    return scoring.lifted(rows, rows.select(F.col("id").alias("src"), F.floor(F.col("id") / 2).cast("long").alias("dst"))).select("id", "band")


NODE_STATES = "SELECT p_partkey AS id, CASE WHEN p_size % 4 <> 0 THEN 'fait' ELSE 'a-faire' END AS etat, ['conforme', 'non-conforme', 'partiel'][p_size % 3 + 1] AS verdict FROM part"


def _judged_nodes(spark, sf_dir):
    size = F.col("p_size")
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(size % 4 != 0, "fait").otherwise("a-faire").alias("etat"), F.element_at(F.array(*map(F.lit, ("conforme", "non-conforme", "partiel"))), size % 3 + 1).alias("verdict"))


@query(f"SELECT id FROM ({NODE_STATES}) WHERE etat = 'fait' AND verdict = 'conforme' ORDER BY id LIMIT 10")
def strong_nodes(spark, sf_dir):
    return scoring.strong_nodes(_judged_nodes(spark, sf_dir)).select("id")


@query(f"""
WITH b AS (SELECT l_partkey AS id, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1)
SELECT id, verdict, coalesce(n, 0) AS n_actions FROM ({NODE_STATES}) LEFT JOIN b USING (id) WHERE etat = 'fait' AND verdict <> 'conforme' ORDER BY coalesce(n, 0) DESC, verdict <> 'non-conforme', id LIMIT 15""")
def weak_nodes(spark, sf_dir):
    bridge = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("node"))
    return scoring.weak_nodes(_judged_nodes(spark, sf_dir), bridge).select("id", "verdict", "n_actions")


@query("""
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 > 1 THEN CAST(o_orderkey * 1000 AS VARCHAR) WHEN o_orderstatus = 'F' THEN '—' ELSE 'gratuit' END AS label,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey || ' jours' WHEN o_orderkey % 3 = 1 THEN o_orderpriority ELSE '' END AS delay, CASE o_orderstatus WHEN 'F' THEN 'IA + PAYANT' WHEN 'O' THEN 'MANUEL + GRATUIT' ELSE '? + GRATUIT' END AS channel, replace(format('{:,}', CAST(o_orderkey * 1000 AS BIGINT)), ',', chr(8239)) AS thousands FROM orders""")
def cost_labels(spark, sf_dir):
    k = F.col("o_orderkey")
    cost = F.when(k % 10 == 0, F.lit(None).cast("string")).when(k % 10 == 1, " 0.0 ").otherwise((k * 1000).cast("string"))
    delay = F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, F.col("o_orderpriority"))
    execution, axis = F.when(F.col("o_orderstatus") == "F", "IA").when(F.col("o_orderstatus") == "O", "MANUEL"), F.when(F.col("o_orderstatus") == "F", "PAYANT").otherwise("GRATUIT")
    return read(spark, sf_dir, "orders").select(k.alias("id"), scoring.cost_label(cost, axis).alias("label"), scoring.delay_label(F.lit(""), delay).alias("delay"), scoring.channel_label(execution, axis).alias("channel"), numbers.thousands(k * 1000).alias("thousands"))


# --- texts -----------------------------------------------------------------------------------------------------

NULLS = ("null", " None ", '"n/a"', "~", "[]", "x", "nothing", "0", "")


@query("""
SELECT p_partkey AS id, CASE p_partkey % 9 WHEN 5 THEN 'x' WHEN 6 THEN 'nothing' WHEN 7 THEN '0' END AS value, CASE p_partkey % 9 WHEN 5 THEN 'x' WHEN 6 THEN 'nothing' WHEN 7 THEN '0' ELSE '-' END || ',kept' AS listed, CASE p_partkey % 9 WHEN 5 THEN 'x' WHEN 6 THEN 'nothing' WHEN 7 THEN '0' END AS mapped, p_size AS size FROM part""")
def null_literals(spark, sf_dir):
    v = F.element_at(F.array(*map(F.lit, NULLS)), (F.col("p_partkey") % 9 + 1).cast("int"))
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.struct(v.alias("value"), F.array(v, F.lit("kept")).alias("listed"), F.create_map(F.lit("k"), F.struct(v.alias("deep"), F.col("p_size").alias("size"))).alias("mapped")).alias("doc"))
    clean = rows.select("id", text.clean_nested(F.col("doc"), rows.schema["doc"].dataType).alias("doc"))
    return clean.select("id", "doc.value", F.array_join("doc.listed", ",", "-").alias("listed"), F.col("doc.mapped")["k"]["deep"].alias("mapped"), F.col("doc.mapped")["k"]["size"].alias("size"))


@query("""
WITH t(i, first, code, prose, items, labels) AS (VALUES
 (0, 'One `SD` two', 'SD', 'One SD two. Three; four; five', 3, 'One `SD` two. Three,four,five'), (1, 'No end here', NULL, 'No end here', NULL, NULL), (2, '**Bold** [link](http://x.com) a: 1;b:2', NULL, 'Bold link a: 1;b:2 ; c;', 3, '**Bold** [link](http,b,c'))
SELECT p_partkey AS id, first, code, prose, CAST(items AS INT) AS items, labels FROM part JOIN t ON p_partkey % 3 = i""")
def text_readings(spark, sf_dir):
    cell = F.element_at(F.array(*map(F.lit, ("One `SD` two. Three; four; five", "No end here", "**Bold** [link](http://x.com) a: 1;b:2 ; c;"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), cell.alias("t"))
    t = F.col("t")
    labels = F.array_join(F.transform(text.enumeration_rows(t), lambda r: r["label"]), ",")
    return rows.select("id", text.first_sentence(t).alias("first"), text.status_code(t).alias("code"), text.markdown_to_prose(t).alias("prose"), F.when(text.enumeration(t).isNotNull(), F.size(text.enumeration(t))).alias("items"), labels.alias("labels"))


@query("""
SELECT p_partkey AS id, 2 AS n_rows, CAST(p_size AS VARCHAR) AS first_cell, p_brand AS last_cell FROM part""")
def markdown_table_cells(spark, sf_dir):
    body = F.concat(F.lit("Before\n\n| n | brand |\n|---|:-:|\n| "), F.col("p_size").cast("string"), F.lit(" | "), "p_brand", F.lit(" |\nafter | not a row"))
    rows = text.markdown_tables(body)
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.size(rows).alias("n_rows"), rows[1][0].alias("first_cell"), rows[1][1].alias("last_cell"))


@query("""
SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 3.5 WHEN 1 THEN -2 WHEN 3 THEN 0.25 END::DOUBLE AS number, CASE p_partkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 0 WHEN 3 THEN 0.25 END::DOUBLE AS clamped, CASE p_partkey % 4 WHEN 2 THEN NULL ELSE p_size END AS small, 28 + p_partkey % 2 AS days FROM part""")
def number_readings(spark, sf_dir):
    k = F.col("p_partkey")
    said = F.element_at(F.array(*map(F.lit, ("about 3,5 s", "-2 or 7", "none", "0.25"))), (k % 4 + 1).cast("int"))
    number = numbers.first_number(said)
    days = numbers.period_days(F.when(k % 2 == 0, "clicks / 28 d").otherwise("clicks"), F.lit("2026-01-01").cast("date"), F.lit("2026-01-29").cast("date"))
    return read(spark, sf_dir, "part").select(k.alias("id"), number.alias("number"), numbers.clamp(number, 0, 3).alias("clamped"), numbers.small_int(F.when(k % 4 != 2, F.concat("p_size", F.lit(".0"))).otherwise("x")).alias("small"), days.cast("long").alias("days"))


# --- snapshots -------------------------------------------------------------------------------------------------


@query("""
SELECT o_orderkey AS id, 'd' || o_custkey || '/run-' || strftime(o_orderdate, '%Y%m%d') || '.json' AS path, 'd' || o_custkey AS domain, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) AS INT) AS place FROM orders""")
def latest_files(spark, sf_dir):
    path = F.concat(F.lit("d"), "o_custkey", F.lit("/run-"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit(".json"))
    files = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), path.alias("path"))
    return snapshot.latest_by_file(files, F.col("path"), F.split("path", "/")[0]).select("id", "path", "domain", "place")


@query("""
SELECT coalesce(a.p_partkey, b.p_partkey) AS id, coalesce(b.p_size + 1, a.p_size) AS measured, CASE WHEN a.p_partkey IS NOT NULL THEN a.p_brand ELSE b.p_brand END AS written FROM
  (SELECT * FROM part WHERE p_partkey % 3 <> 0) a FULL JOIN (SELECT * FROM part WHERE p_partkey % 2 = 0) b ON a.p_partkey = b.p_partkey""")
def merged_snapshot(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    base = part.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("measured"), F.col("p_brand").alias("written"))
    fresh = part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), (F.col("p_size") + 1).alias("measured"), F.col("p_brand").alias("fresh_brand"))
    out = snapshot.merge(base, fresh, "id", ["measured", "fresh_brand"])
    return out.select("id", "measured", F.coalesce("written", "fresh_brand").alias("written"))


@query("""
SELECT l_orderkey AS study, l_linenumber AS step, l_partkey AS part, l_suppkey AS supp, coalesce(min((l_linestatus = 'F')::INT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) = 1 AS may_close FROM lineitem""")
def step_guard(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("study"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("order"), F.col("l_linenumber").alias("step"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.when(F.col("l_linestatus") == "F", "fait").otherwise("en-cours").alias("status"))
    return snapshot.step_guard(rows, "study", "order", "status").select("study", "step", "part", "supp", "may_close")


@query("""
SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'create' WHEN 1 THEN 'same' WHEN 2 THEN 'replace' ELSE 'keep' END AS plan FROM part""")
def file_plan(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    wanted = part.select(k.alias("id"), F.lit("new").alias("new"))
    there = part.where(k % 4 != 0).select(k.alias("id"), F.when(k % 4 == 1, "new").when(k % 4 == 2, "old").otherwise("old").alias("written"), F.when(k % 4 == 1, "new").when(k % 4 == 2, "old").otherwise("edited").alias("current"))
    return snapshot.fingerprint_plan(wanted, there, "id", "new", force=True).select("id", "plan")


CONTRACT = {"type": "object", "required": ["id", "n"], "additionalProperties": False, "properties": {"id": {"$ref": "#/$defs/id"}, "n": {"type": "array", "minItems": 1, "maxItems": 3, "items": {"type": "integer", "minimum": 1, "maximum": 49}}, "s": {"enum": ["a", None]}}, "$defs": {"id": {"type": "integer"}}}


@query("""
SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN CASE WHEN p_size > 49 THEN '$.n[0]: is above 49' ELSE '' END WHEN 1 THEN '$.n: has fewer than 1 items' WHEN 2 THEN '$.n: is missing;$.x: is unknown' WHEN 3 THEN '$.n[1]: is not of type ''integer''' WHEN 4 THEN '$.s: is not one of [''a'', None]' ELSE '$: is not readable JSON' END AS violations FROM part""")
def contract_violations(spark, sf_dir):
    k, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    tail = F.element_at(F.array(F.concat(F.lit(', "n": ['), size, F.lit('], "s": null}')), F.lit(', "n": []}'), F.lit(', "x": 0}'), F.lit(', "n": [1, true, 3]}'), F.lit(', "n": [1], "s": "b"}'), F.lit(', "n": [1')), (F.col("p_partkey") % 6 + 1).cast("int"))
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit('{"id": '), k, tail).alias("body"))
    return snapshot.contract_violations(rows, CONTRACT).select("id", F.array_join("violations", ";").alias("violations"))


@query("""
SELECT p_partkey AS id, '$.a' AS path, 'x' AS cle, 'T1' AS preuve FROM part UNION ALL SELECT p_partkey, '$.a.more[' || p_size % 2 || ']', 'y' || p_size, 'T2' FROM part""")
def tagged_metrics(spark, sf_dir):
    y = F.concat(F.lit('{"cle": "y'), "p_size", F.lit('", "preuve": "T2"}'))
    body = F.concat(F.lit('{"a": {"cle": "x", "preuve": "T1", "more": ['), F.when(F.col("p_size") % 2 == 1, F.concat(F.lit('{"cle": "z"}, '), y)).otherwise(y), F.lit("]}}"))
    return snapshot.tagged_metrics(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), body.alias("body")))


# --- checks ----------------------------------------------------------------------------------------------------


@query("""
SELECT 'FAIL' AS verdict, count(*) AS total, count(*) FILTER (s_acctbal >= 0) AS passed, coalesce(string_agg(s_name, ',' ORDER BY s_name) FILTER (s_acctbal < 0), '') AS failed FROM supplier HAVING count(*) FILTER (s_acctbal < 0) > 0
UNION ALL SELECT 'PASS', count(*), count(*), '' FROM supplier HAVING count(*) FILTER (s_acctbal < 0) = 0""")
def check_envelope(spark, sf_dir):
    checks = read(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), (F.col("s_acctbal") >= 0).alias("ok"))
    return rules.envelope(checks).withColumn("failed", F.array_join("failed", ","))


@query("""
WITH c AS (SELECT count(*) AS total, count(*) FILTER (s_acctbal >= 0) AS passed, list(s_name ORDER BY s_name) FILTER (s_acctbal < 0) AS failed FROM supplier)
SELECT CASE WHEN total = passed THEN 'PASS' ELSE 'FAIL' END AS verdict, total, len(coalesce(failed, [])) AS failures FROM c""")
def verdict_document(spark, sf_dir):
    checks = read(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), (F.col("s_acctbal") >= 0).alias("ok"))
    body = F.from_json("value", "verdict string, total long, passed long, failed array<string>")
    return sinks.verdict_json(checks).select(body.alias("b")).select("b.verdict", "b.total", F.size("b.failed").cast("long").alias("failures"))


@query("""
WITH s AS (SELECT p_partkey AS id, p_partkey % 6 AS k FROM part)
SELECT id, CASE k WHEN 1 THEN 'missing: plan_langues, plan_surfaces' WHEN 2 THEN 'fewer than two runs' WHEN 3 THEN 'fewer than two runs;no dispersion' ELSE '' END AS violations FROM s""")
def measurement_plans(spark, sf_dir):
    k = F.col("p_partkey") % 6
    rows = read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.lit("f").alias("plan_formulations"), F.when(k == 1, "~").otherwise("fr").alias("plan_langues"), F.when(k == 1, '""').otherwise("s").alias("plan_surfaces"),
        F.when(k.isin(2, 3), '"1"').otherwise("3").alias("plan_reexecutions"), F.when(k == 3, "-").otherwise("1-2").alias("dispersion"), F.when(k == 4, "non-mesure").otherwise("conforme").alias("verdict"), F.when(k == 5, "stable").otherwise("Non reproductible").alias("reserve"),
    )
    return rules.measurement_plan(rows).select("id", F.array_join("violations", ";").alias("violations"))


@query("SELECT p_partkey AS id, p_partkey % 5 <> 0 AS ok, p_partkey % 2 = 0 OR p_partkey % 3 = 0 AS field_ok FROM part")
def evidence_checks(spark, sf_dir):
    k = F.col("p_partkey")
    said = F.element_at(F.array(*map(F.lit, ("llms.txt answers", "llms.txt lists 12 URLs", "llms.txt absent", "llms.txt says « allow all »", "nothing of it"))), (k % 5 + 1).cast("int"))
    rows = read(spark, sf_dir, "part").select(k.alias("id"), F.when(k % 2 == 0, "llms.txt, export").otherwise("CrUX et llms.txt").alias("source_requise"), F.when(k % 3 == 0, "non-mesure").otherwise("conforme").alias("field_verdict"), F.lit("conforme").alias("verdict"), said.alias("constat"))
    read_ = rules.directive_file_read(rows).select("id", "ok")
    field = rules.field_evidence(rows.drop("verdict").withColumnRenamed("field_verdict", "verdict"), usable=False).select("id", F.col("ok").alias("field_ok"))
    return read_.join(field, "id")


@query("""
SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 1 THEN 'tier is not T1' WHEN 2 THEN 'no period' WHEN 3 THEN 'no read date;no period' ELSE '' END AS violations FROM orders""")
def connector_reads(spark, sf_dir):
    k, day = F.col("o_orderkey") % 5, F.date_format("o_orderdate", "yyyy-MM-dd")
    full = F.concat(F.lit("Connecteur, lu le "), day, F.lit(", période 2025-01-01 / 2025-12-31"))
    source = F.when(k == 2, F.concat(F.lit("CONNECTEUR, Lue  le "), day)).when(k == 3, "connecteur, hier").when(k == 4, "export").otherwise(full)
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(k == 1, "T2").otherwise("T1").alias("preuve"), source.alias("source"))
    return rules.connector_metrics(rows).select("id", F.array_join("violations", ";").alias("violations"))


@query("""
SELECT p_partkey AS id, a.p_brand AS authority FROM part p JOIN (SELECT p_partkey AS k, p_brand FROM part WHERE p_partkey % 2 = 0) a ON a.k = p.p_partkey - 1 WHERE p.p_partkey % 2 = 1""")
def duplicate_nodes(spark, sf_dir):
    k = F.col("p_partkey")
    nodes = read(spark, sf_dir, "part").select(k.alias("id"), F.concat(F.lit("Node "), k).alias("noeud"), F.col("p_brand").alias("branche"), F.when(k % 2 == 1, F.concat(F.lit("NODE "), (k - 1).cast("string"))).alias("doublon_de"))
    return rules.resolve_duplicates(nodes).select("id", "authority")


@query("SELECT count(*) = count(DISTINCT p_partkey + 1) AND min(p_partkey + 1) = 1 AND max(p_partkey + 1) = count(*) AS ok, count(*) AS n, min(p_partkey + 1) AS lowest, max(p_partkey + 1) AS highest FROM part")
def contiguous_ids(spark, sf_dir):
    return rules.contiguous(read(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("id")))


@query("""
SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 't' || c_custkey ELSE '' END AS missing, c_custkey % 3 <> 0 AS ok FROM customer""")
def uncounted_tables(spark, sf_dir):
    k = F.concat(F.lit("t"), F.col("c_custkey").cast("string"))
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.array(F.lit("a"), k).alias("filterable"), F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(k, F.lit("a"), F.lit("b"))).alias("counted"))
    return table.uncounted(rows).select("id", F.array_join("missing", ",").alias("missing"), "ok")


# --- versions --------------------------------------------------------------------------------------------------


@query("""
WITH p AS (SELECT p_partkey AS k, p_size AS s FROM part)
SELECT 'unreadable_id' AS reason, 'x' || k AS id FROM p WHERE k % 10 = 0 UNION ALL SELECT 'retired_or_orphan_with_work', CAST(k AS VARCHAR) FROM p WHERE k % 10 = 1 AND k % 4 = 1
UNION ALL SELECT 'unknown_target', CAST(k AS VARCHAR) FROM p WHERE k % 10 = 3
UNION ALL SELECT 'collision', CAST(min(k) AS VARCHAR) FROM (SELECT k, CASE WHEN k % 10 = 4 THEN -4 ELSE k END AS n FROM p WHERE k % 10 NOT IN (0, 1)) GROUP BY n HAVING count(*) > 1""")
def migration_refusals(spark, sf_dir):
    k = F.col("p_partkey").cast("int")
    part = read(spark, sf_dir, "part").select(k.alias("k"))
    sheets = part.select(F.when(F.col("k") % 10 == 0, F.concat(F.lit("x"), "k")).otherwise(F.lpad(F.col("k").cast("string"), 9, "0")).alias("id"), (F.col("k") % 4 == 1).alias("has_work"))
    mapping = part.where("k % 10 <> 1").select(F.col("k").alias("id"), F.when(F.col("k") % 10 == 4, F.lit(-4)).otherwise(F.col("k")).alias("new_id"))
    known = part.where("k % 10 <> 3").select(F.when(F.col("k") % 10 == 4, F.lit(-4)).otherwise(F.col("k")).alias("id"))
    found = migrate.refusals(sheets, mapping, known, chain_found=True)
    return found.select("reason", F.regexp_replace("id", r"^0+(?=\d)", "").alias("id"))


@query("""
WITH m AS (SELECT p_partkey AS id, p_size % 20 AS n FROM part), k AS (SELECT unnest(range(25)) AS id)
SELECT id FROM k WHERE id NOT IN (SELECT n FROM m) AND id <> 22""")
def unexplained_holes(spark, sf_dir):
    mapping = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 20).cast("long").alias("new_id"))
    return migrate.holes(mapping, spark.range(25), spark.createDataFrame([(22,)], "id long"))


@query("SELECT p_size AS id, count(DISTINCT p_brand) AS n FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def ambiguous_ids(spark, sf_dir):
    return migrate.ambiguous(read(spark, sf_dir, "part").select(F.col("p_size").alias("id"), F.col("p_brand").alias("new_id")))


@query("""
SELECT p_partkey AS id, concat_ws(',', CASE WHEN p_partkey % 3 = 0 THEN 'question' END, CASE WHEN p_partkey % 5 = 0 THEN 'critere' END) AS fields FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 5 = 0""")
def criterion_drift(spark, sf_dir):
    k = F.col("p_partkey")
    part = read(spark, sf_dir, "part")
    old = part.select(k.alias("id"), F.lit("How  many\nnow ").alias("question"), F.lit("m").alias("methode"), F.col("p_brand").alias("critere"))
    new = part.select(k.alias("id"), F.when(k % 3 == 0, "How few").otherwise("How many now").alias("question"), F.lit(" m").alias("methode"), F.when(k % 5 != 0, F.col("p_brand")).alias("critere"))
    return migrate.criterion_drift(old, new, "id", ["question", "methode", "critere"]).select("id", F.array_join("fields", ",").alias("fields"))


@query("""
SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_size IN (7, 35) THEN CAST(p_size AS VARCHAR) ELSE '' END AS moved, CASE WHEN p_partkey % 3 = 0 THEN p_size || '-' || (p_size + 3) ELSE '' END AS ranges FROM part""")
def cited_moves(spark, sf_dir):
    size = F.col("p_size").cast("string")
    said = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("See nodes "), size, F.lit("-"), (F.col("p_size") + 3).cast("string"), F.lit("."))).otherwise(F.concat(F.lit("As nœud "), size, F.lit(" says")))
    found = migrate.cited_moves(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), said.alias("t")), "t", {7: 8, 35: 36, 3: 4} | {})
    return found.select("id", F.array_join(F.filter("moved", lambda x: x != 3), ",").alias("moved"), F.array_join("ranges", ",").alias("ranges"))


@query("""
SELECT o_custkey AS term, min(o_orderkey) AS first FROM orders GROUP BY 1""")
def first_uses(spark, sf_dir):
    return table.first_use(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("term"), F.col("o_orderkey").alias("first")), "term", "first")


# --- what is written and read back -----------------------------------------------------------------------------


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY 1, 2")
def partitioned_rerun(spark, sf_dir):
    """Written twice by status: the second run replaces the first."""
    rows, path = read(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n")), _folder(spark, "partitioned")
    sinks.write_partitioned(rows, path, "status")
    sinks.write_partitioned(rows.where("status = 'F'"), path, "status")
    return spark.read.schema("priority string, n long, status string").json(path)


@query("SELECT p_partkey AS id, p_size AS size FROM part")
def snapshot_roundtrip(spark, sf_dir):
    path = _folder(spark, "snapshot")
    body = F.concat(F.lit('{"id": '), F.col("p_partkey").cast("string"), F.lit(', "n": ['), F.col("p_size").cast("string"), F.lit("]}"))
    wider = CONTRACT | {"properties": CONTRACT["properties"] | {"n": {"type": "array", "minItems": 1, "maxItems": 3, "items": {"type": "integer", "minimum": 1, "maximum": 50}}}}
    sinks.write_snapshot(read(spark, sf_dir, "part").select(body.alias("body")), path, wider)
    return spark.read.schema("id long, n array<int>").json(path).select("id", F.col("n")[0].alias("size"))


@query("SELECT 'A' || s_suppkey AS id, (1 + s_suppkey % 5) * 4 / 2.0::DOUBLE AS score, CAST(43 + s_suppkey % 7 AS INT) AS first_node FROM supplier")
def action_list_roundtrip(spark, sf_dir):
    path, k = _folder(spark, "actions"), F.col("s_suppkey")
    given = {"id": F.concat(F.lit("A"), k), "volet": F.lit("ETAT"), "noeuds_couverts": F.concat((43 + k % 7).cast("string"), F.lit(", 19")), "gain": (1 + k % 5).cast("string"), "confiance": F.lit("4"), "effort": F.lit("2"), "horizon": F.lit("quick-win"), "axe_execution": F.lit("IA"), "regime_automatisation": F.lit("bout-en-bout"), "axe_cout": F.lit("GRATUIT"), "cout_eur": F.lit("0"), "dependance_de": F.lit(None).cast("string")}
    sinks.write_actions(read(spark, sf_dir, "supplier").select(*[given.get(c, F.lit("x")).alias(c) for c in (*scoring.REQUIRED, "dependance_de")]), path)
    back = documents.read_actions(spark, path)
    return back.select("id", F.col("score").cast("double").alias("score"), F.col("node_ids")[0].alias("first_node"))


@query("SELECT s_suppkey AS id, s_name AS name, 'rewritten' AS note FROM supplier")
def verified_rewrite(spark, sf_dir):
    before = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("first").alias("note"))
    return sinks.write_verified(before.withColumn("note", F.lit("rewritten")), _folder(spark, "verified"), before, ["note"])


@query("""
SELECT 'v' || n AS de, 'v' || (n + 1) AS vers, CAST(n * 10 AS INT) AS moved_to, CAST(n + 100 AS INT) AS retired FROM (SELECT unnest(range(1, 6)) AS n)""")
def evolution_file(spark, sf_dir):
    path = _folder(spark, "registry")
    evolutions = [{"de": f"v{n}", "vers": f"v{n + 1}", "date": "2026-01-01", "motif": "m", "correspondances": {str(n): n * 10}, "identifiants_retires": [n + 100], "identifiants_nouveaux": []} for n in range(1, 6)]
    spark.createDataFrame([(json.dumps({"version_courante": "v6", "evolutions": evolutions}),)], "value string").coalesce(1).write.text(path)
    found = documents.evolution_registry(spark, path)
    return found.select("de", "vers", F.map_values("correspondances")[0].alias("moved_to"), F.col("identifiants_retires")[0].alias("retired"))


@query("SELECT user_id, count(*) AS lines FROM events GROUP BY 1")
def log_files(spark, sf_dir):
    """Gzipped log files, written, read and parsed."""
    path = _folder(spark, "logs")
    line = F.concat(F.lit('10.0.0.1 - - [01/Jan/2026:00:00:00 +0000] "GET /p/'), "user_id", F.lit(' HTTP/1.1" 200 10 "-" "x"'))
    read(spark, sf_dir, "events").select(line.alias("value")).write.option("compression", "gzip").text(path)
    parsed = log_lines.parse(log_lines.read(spark, path))
    return parsed.groupBy(F.regexp_extract("path", r"(\d+)$", 1).cast("long").alias("user_id")).agg(F.count("*").alias("lines"))


# --- reference data and study as facts -------------------------------------------------------------------------


def _grid(spark, sf_dir):
    """Parts as nodes of a grid: every tenth has a slug that is not made from its name, sizes are branches."""
    k = F.col("p_partkey")
    name = F.concat(F.lit("Nœud n° "), k.cast("string"))
    return read(spark, sf_dir, "part").select(
        k.alias("id"), F.floor(k / 100).cast("long").alias("branche"), name.alias("noeud"), F.concat(F.when(k % 10 == 0, "Nud_n-").otherwise("nud-n-"), k.cast("string")).alias("slug_noeud"), F.col("p_type").alias("source_requise"),
        F.concat(F.lit("seo/b"), F.floor(k / 100).cast("string"), F.lit("/n"), k.cast("string")).alias("chemin"), F.col("p_size").alias("size"), F.col("p_name").alias("name"),
    )


CHECK_SQL = """
WITH n AS (SELECT p_partkey AS id, p_partkey // 100 AS branche, p_type, p_size, p_name, 'seo/b' || p_partkey // 100 || '/n' || p_partkey AS chemin FROM part), t AS (SELECT count(*) AS c, count(DISTINCT branche) AS b FROM n),
o(name, subject) AS (
  SELECT 'counts', 'nodes: ' || c FROM t WHERE c <> 89 UNION ALL SELECT 'counts', 'branches: ' || b FROM t WHERE b <> 17
  UNION ALL SELECT 'slugs', 'Nud_n-' || id FROM n WHERE id % 10 = 0
  UNION ALL SELECT 'scattered', CAST(p_size % 5 AS VARCHAR) FROM n GROUP BY p_size % 5 HAVING max(id) - min(id) + 1 <> count(*)
  UNION ALL SELECT 'client data', CAST(id AS VARCHAR) FROM n WHERE regexp_matches(p_name, '\\bring\\b')
  UNION ALL SELECT 'bounds', id || '.size' FROM n WHERE p_size > 40
  UNION ALL SELECT 'empty folders', 'seo/b' || b FROM (SELECT DISTINCT branche AS b FROM n) WHERE b % 2 = 1
  UNION ALL SELECT 'versions', chemin FROM n WHERE p_size = 7
  UNION ALL SELECT 'registry', 'v3' UNION ALL SELECT 'registry', 'v1'
  UNION ALL SELECT 'summary', p_type FROM n GROUP BY p_type HAVING count(*) % 2 = 1
  UNION ALL SELECT 'sources', p_type FROM (SELECT DISTINCT p_type FROM n) WHERE p_type > 'M' UNION ALL SELECT 'sources', 'NEVER NEEDED'
  UNION ALL SELECT 'tree', chemin FROM n WHERE id % 50 = 3 UNION ALL SELECT 'tree', 'seo/extra'
  UNION ALL SELECT 'sections', id || ': Preuves' FROM n WHERE id % 7 = 0
  UNION ALL SELECT 'transposable', chemin FROM n WHERE id % 97 = 5
  UNION ALL SELECT 'projections', id || ':2' FROM n WHERE id % 9 = 4)
SELECT c.name, count(o.subject) = 0 AS ok, count(o.subject) AS n, coalesce(array_to_string((list_sort(list(o.subject)))[1:5], ','), '') AS examples
FROM (VALUES ('counts'), ('slugs'), ('scattered'), ('client data'), ('bounds'), ('empty folders'), ('versions'), ('registry'), ('summary'), ('sources'), ('tree'), ('sections'), ('counters'), ('transposable'), ('projections')) c(name) LEFT JOIN o USING (name) GROUP BY 1"""


@query(CHECK_SQL)
def reference_checks(spark, sf_dir):
    nodes = _grid(spark, sf_dir)
    texts = nodes.select("id", F.concat(F.lit("## Constat\nup 5 "), F.when(F.col("id") % 9 == 4, "%").otherwise("% [a.csv]"), F.when(F.col("id") % 7 == 0, "").otherwise("\n## Preuves\nx")).alias("text"))
    registry = spark.createDataFrame([("v0", "v1"), ("v1", "v2"), ("v1", "v3")], "de string, vers string")
    counted = nodes.groupBy("source_requise").agg(F.count("*").alias("n"))
    files = nodes.where("branche % 2 = 0").select(F.col("chemin").alias("path"))
    folders = nodes.select(F.concat(F.lit("seo/b"), F.col("branche").cast("string")).alias("path")).distinct()
    sheets = nodes.where("id % 50 <> 3").select("chemin").unionByName(spark.createDataFrame([("seo/extra",)], "chemin string"))
    states = snapshot.state_counters(nodes.withColumn("state", F.lit("fait")), "state")
    found = checks.facts({
        "counts": checks.wrong_counts(nodes), "slugs": checks.bad_slugs(nodes), "scattered": checks.scattered_branches(nodes.withColumn("branche", F.col("size") % 5)),
        "client data": checks.client_data(nodes, "name", ["Ring"], "id"), "bounds": checks.out_of_bounds(nodes, "id", {"size": (1, 40), "branche": (0, 10**9)}),
        "empty folders": checks.empty_folders(folders, files), "versions": checks.other_versions(nodes.withColumn("version", F.when(F.col("size") != 7, "v2")), "v2", "chemin"), "registry": checks.stale_registry(registry, "v2"),
        "summary": checks.wrong_summaries(counted.withColumn("n", F.col("n") - F.col("n") % 2), nodes, "source_requise"),
        "sources": checks.unlisted_sources(nodes, nodes.where("source_requise <= 'M'").select("source_requise").unionByName(spark.createDataFrame([("NEVER NEEDED",)], "source_requise string"))),
        "tree": checks.sheets_off_tree(nodes, sheets), "sections": checks.missing_sections(texts, "id", "text", ("Constat", "Preuves")), "counters": checks.wrong_counters(states, states),
        "transposable": checks.not_transposable(nodes.select(F.col("chemin").alias("subject"), F.when(F.col("id") % 97 == 5, "v9").otherwise("v1").alias("version")), migrate.chains(registry, "v0")), "projections": checks.bare_projections(texts, "text", "id"),
    })
    return found.withColumn("examples", F.array_join("examples", ","))
