"""Actions: checks of form, scores, priority, coverage of nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.functions.numbers import half_even
from tidewrack.functions.text import first_sentence, ids_in_cell
from tidewrack.operators.table import global_rank

#: Closed vocabularies and required fields of an action.
VOCABULARIES = {
    "volet": ("ETAT", "STRATEGIE"),
    "horizon": ("quick-win", "structurant", "fondation"),
    "axe_execution": ("IA", "MANUEL"),
    "regime_automatisation": ("bout-en-bout", "ia-assistee-validation-humaine", "manuel-strict"),
    "axe_cout": ("GRATUIT", "PAYANT"),
}
REQUIRED = (
    "id", "action", "volet", "noeuds_couverts", "gain", "cran_gain_cite", "effort", "cran_effort_cite", "confiance", "cran_confiance_cite",
    "horizon", "delai_realisation", "delai_effet_mesurable", "critere_acceptation", "hypothese_structurante", "axe_execution",
    "regime_automatisation", "axe_cout", "cout_eur", "trimestre_cible",
)
COLUMNS = (*REQUIRED[:10], "score", *REQUIRED[10:], "dependance_de")
SCALES = ("gain", "effort", "confiance")
CUT, WATCH = 6, 2
#: Strong points, weak points and actions that a report shows.
STRONG, WEAK, SHOWN = 10, 15, 40


def score(gain: Column, confidence: Column, effort: Column) -> Column:
    return half_even(gain * confidence / effort, 2)


def violations(actions: DataFrame) -> DataFrame:
    """Adds `violations`, an array of messages. A row that lacks fields is judged on that alone."""
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    missing = F.filter(F.array(*[F.when(text(c) == "", F.lit(c)) for c in REQUIRED]), lambda x: x.isNotNull())
    scale = lambda c: F.when(~F.coalesce(F.col(c).cast("string").try_cast("int").between(1, 5), F.lit(False)), F.concat(F.lit(f"{c} is not between 1 and 5: "), text(c)))
    closed = [F.when(~text(c).isin(*v), F.concat(F.lit(f"{c} is not in its vocabulary: "), text(c))) for c, v in VOCABULARIES.items()]
    names = actions.select(F.col("id").alias("_known")).distinct()
    rows = actions.join(names, F.col("dependance_de") == F.col("_known"), "left")
    found = F.filter(
        F.array(*map(scale, SCALES), *closed, F.when(F.size(ids_in_cell(F.col("noeuds_couverts"))) == 0, F.lit("no node is covered")), F.when((text("dependance_de") != "") & F.col("_known").isNull(), F.concat(F.lit("unknown dependency: "), text("dependance_de")))),
        lambda x: x.isNotNull(),
    )
    first = F.array(F.concat(F.lit("missing: "), F.array_join(missing, ", ")))
    return rows.withColumn("violations", F.when(F.size(missing) > 0, first).otherwise(found)).drop("_known")


def duplicate_ids(actions: DataFrame) -> DataFrame:
    return actions.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def scored(actions: DataFrame, position: str) -> DataFrame:
    """Valid actions with score and place, best first, equals in their given order."""
    rows = actions.withColumn("score", score(F.col("gain"), F.col("confiance"), F.col("effort")))
    return global_rank(rows, [F.desc("score"), F.col(position)], "place")


def refuse_invalid(actions: DataFrame) -> DataFrame:
    """The actions, or an error that names the violations: a batch is taken whole or not at all."""
    bad = violations(actions).where(F.size("violations") > 0).select("id", "violations").limit(20).collect()
    twice = [r["id"] for r in duplicate_ids(actions).limit(20).collect()]
    if bad or twice:
        raise ValueError(f"refused: {[(r['id'], r['violations']) for r in bad]} repeated ids: {twice}")
    return actions


def band(value: Column) -> Column:
    return F.when(value >= CUT, "do").when(value >= WATCH, "watch").when(value.isNotNull(), "drop")


def lifted(actions: DataFrame, depends_on: DataFrame) -> DataFrame:
    """Actions below the cut that one above it depends on, directly or not, are done as well. depends_on: (src, dst) ids."""
    from tidewrack.operators.graph import closure

    kept = actions.where(F.col("score") >= CUT).select(F.col("id").alias("node"))
    needed = closure(depends_on, kept).withColumnRenamed("node", "id").withColumn("_n", F.lit(True))
    return actions.join(needed, "id", "left").withColumn("band", F.when(F.col("_n") & (F.col("score") < CUT), "do").otherwise(band(F.col("score")))).drop("_n")


def gain_effort_matrix(actions: DataFrame, gain: str, effort: str, value: str) -> DataFrame:
    """Count, sum and best of a value in each gain and effort cell; rows off the scale are left out."""
    rows = actions.where(F.col(gain).between(1, 5) & F.col(effort).between(1, 5))
    out = rows.groupBy(gain, effort).agg(F.count("*").alias("n"), F.max(value).alias("best"), F.sum(value).alias("total"))
    return out.withColumn("hot", (F.col(gain) >= 4) & (F.col(effort) <= 2)).withColumn("cold", (F.col(gain) <= 2) & (F.col(effort) >= 4))


def quadrants(actions: DataFrame, a: str, b: str, effort: str, value: str, key: str) -> DataFrame:
    """Count, effort and head (best value, least key of equals) of each quadrant."""
    head = F.max_by(F.col(key), F.struct(F.col(value), -F.col(key)))
    return actions.groupBy(a, b).agg(F.count("*").alias("n"), F.sum(effort).alias("effort"), head.alias("head"))


def fixed_quadrants(actions: DataFrame, order: str = "id") -> DataFrame:
    """(quadrant, n, effort, head) of the four quadrants that there are, empty ones included.

    effort adds up whole numbers, other values being none; head is the best-scored action, of equals the first by `order`, or a dash."""
    rows = actions.select("axe_execution", "axe_cout", F.col("effort").cast("string").try_cast("double").try_cast("int").alias("e"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("s"), F.col(order).alias("o"), F.coalesce("action", "libelle").alias("a"))
    found = rows.groupBy(F.col("axe_execution").alias("x"), F.col("axe_cout").alias("c")).agg(F.count("*").alias("n"), F.sum("e").alias("effort"), F.min(F.struct((-F.col("s")).alias("s"), "o", "a")).alias("best"))
    axes = actions.sparkSession.createDataFrame([(x, c) for x in VOCABULARIES["axe_execution"] for c in VOCABULARIES["axe_cout"]], "execution string, cost string")
    met = axes.join(found, (F.col("execution") == F.col("x")) & (F.col("cost") == F.col("c")), "left")
    head = F.when(F.col("n").isNull(), "—").otherwise(F.coalesce(first_sentence(F.col("best.a")), F.lit("")))
    return met.select(channel_label(F.col("execution"), F.col("cost")).alias("quadrant"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("effort", F.lit(0)).cast("long").alias("effort"), head.alias("head"))


def blocking_nodes(bridge: DataFrame, node: str, gain: str) -> DataFrame:
    """Nodes by how many actions they carry, then by gain, then by id; place 1 is the blocking one."""
    out = bridge.groupBy(node).agg(F.count("*").alias("n_actions"), F.sum(gain).alias("total_gain"))
    return global_rank(out, [F.desc("n_actions"), F.desc("total_gain"), F.col(node)], "place")


def bridge(actions: DataFrame, ids: str = "node_ids") -> DataFrame:
    """(action, position, node): one row for each node an action names, in its order."""
    return actions.select("id", F.posexplode(ids).alias("position", "node"))


def named_nodes(actions: DataFrame, nodes: DataFrame, ids: str = "node_ids") -> DataFrame:
    """Adds `nodes`, the names of the known nodes an action covers, in order. nodes: (node, name)."""
    met = bridge(actions, ids).join(nodes, "node")
    listed = met.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "node", "name"))), lambda x: x["name"]).alias("nodes"))
    return actions.join(listed, "id", "left").withColumn("nodes", F.coalesce("nodes", F.array().cast("array<string>")))


def actions_of_nodes(nodes: DataFrame, bridge_: DataFrame, key: str = "node") -> DataFrame:
    """Adds n_actions and actions, the sorted ids of the actions that name a node; a node that none names has 0 and an empty list.

    bridge_: (id, key) rows."""
    listed = bridge_.groupBy(key).agg(F.count_distinct("id").alias("n_actions"), F.array_sort(F.collect_set("id")).alias("actions"))
    met = nodes.join(listed, key, "left")
    return met.withColumn("n_actions", F.coalesce("n_actions", F.lit(0))).withColumn("actions", F.coalesce("actions", F.slice(F.array(F.lit(None).cast(dict(bridge_.dtypes)["id"])), 1, 0)))


def strong_nodes(nodes: DataFrame, n: int = STRONG) -> DataFrame:
    """The first n finished nodes that conform, in the order of the grid."""
    return nodes.where("etat = 'fait' and verdict = 'conforme'").orderBy("id").limit(n)


def weak_nodes(nodes: DataFrame, bridge_: DataFrame, n: int = WEAK) -> DataFrame:
    """The first n finished nodes that do not conform: most actions first, then plain failures before partial ones, then by id."""
    rows = nodes.where(F.col("etat").eqNullSafe(F.lit("fait")) & F.col("verdict").isin("non-conforme", "partiel"))
    met = actions_of_nodes(rows.withColumn("node", F.col("id")), bridge_).drop("node")
    return met.orderBy(F.desc("n_actions"), F.col("verdict") != "non-conforme", "id").limit(n)


def shown_actions(actions: DataFrame, n: int = SHOWN) -> DataFrame:
    """The n best actions; equals by id."""
    return actions.orderBy(F.desc("score"), "id").limit(n)


def attachment(actions: DataFrame, bridge_: DataFrame, key: str) -> DataFrame:
    """Share of actions that name a node, and how many are named: all unattached actions on a non-empty list fail."""
    attached = bridge_.select(key).distinct().withColumn("_a", F.lit(1))
    out = actions.join(attached, key, "left").agg(F.count("*").alias("n"), F.count("_a").alias("n_attached"))
    return out.withColumn("rate", F.try_divide(F.col("n_attached").cast("double"), F.col("n"))).withColumn("ok", (F.col("n") == 0) | (F.col("n_attached") > 0))


#: How an action without a cost is written down.
NO_COST = ("", "0", "0.0", "-")


def cost_label(cost: Column, axis: Column) -> Column:
    """An action's cost as it was written; without one it is free, or, if its axis says that it is paid, not known."""
    text = F.trim(F.coalesce(cost.cast("string"), F.lit("")))
    return F.when(~text.isin(*NO_COST), text).when(axis.eqNullSafe(F.lit("PAYANT")), "—").otherwise("gratuit")


def delay_label(*delays: Column) -> Column:
    """The first of some delays that is given; a bare number is one of days."""
    text = F.coalesce(*[F.nullif(F.trim(d.cast("string")), F.lit("")) for d in delays], F.lit(""))
    return F.when(text.rlike(r"^\d+([.,]\d+)?$"), F.concat(text, F.lit(" jours"))).otherwise(text)


def channel_label(execution: Column, cost: Column) -> Column:
    """Who carries an action out and what it costs, a question mark for what is not said."""
    told = lambda c: F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit("?"))
    return F.concat(told(execution), F.lit(" + "), told(cost))
