"""Rules over rows: what is judged, what is only named, and how verdicts are folded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.functions.text import NULL_PLAN, read_evidence, says_absent
from tidewrack.operators.snapshot import AFFIRMATIVE, not_reproducible

#: What a measurement plan must declare.
PLAN_FIELDS = ("plan_formulations", "plan_langues", "plan_surfaces", "plan_reexecutions")


def fold(rows: DataFrame, keys: list[str], verdict: str = "verdict") -> DataFrame:
    """One verdict for each key: FAIL if any fails, else PASS if any passes, else SANS_OBJET: no subject is no success."""
    v = F.col(verdict)
    out = F.when(F.bool_or(v == "FAIL"), "FAIL").when(F.bool_or(v == "PASS"), "PASS").otherwise("SANS_OBJET")
    return rows.groupBy(*keys).agg(out.alias("verdict"), F.count("*").alias("subjects"), F.count_if(v == "FAIL").alias("failed"))


def fold_compliance(rows: DataFrame, waivers: DataFrame | None = None, key: str = "id", blocking: str = "blocking", judged: str = "judged") -> DataFrame:
    """SKIP if nothing could be judged, PASS if all that was conforms, else FAIL. A waived row counts as conforming and stays listed."""
    w = rows.withColumn("_w", F.lit(False)) if waivers is None else rows.join(waivers.select(key, F.lit(True).alias("_w")).distinct(), key, "left")
    waived = F.coalesce("_w", F.lit(False))
    n, bad = F.count_if(F.col(judged)), F.count_if(F.col(judged) & F.col(blocking) & ~waived)
    return w.agg(n.alias("judged"), (n - bad).alias("conforming"), F.count_if(F.col(blocking) & waived).alias("waived")).withColumn("verdict", F.when(F.col("judged") == 0, "SKIP").when(F.col("judged") == F.col("conforming"), "PASS").otherwise("FAIL"))


def envelope(checks: DataFrame, name: str = "name", ok: str = "ok") -> DataFrame:
    """(verdict, total, passed, failed): the checks in one row; failed lists their names."""
    names = F.array_sort(F.collect_list(F.when(~F.col(ok), F.col(name))))
    out = checks.agg(F.count("*").alias("total"), F.count_if(F.col(ok)).alias("passed"), names.alias("failed"))
    return out.select(F.when(F.size("failed") == 0, "PASS").otherwise("FAIL").alias("verdict"), "total", "passed", "failed")


def judge_targets(declared: DataFrame, pages: DataFrame) -> DataFrame:
    """Each declared (url, target) with the target's status: PASS for a plain 200, FAIL for any other answer, and
    UNSEEN where the target was not crawled: it is named and not judged."""
    seen = pages.select(F.col("url").alias("target"), F.col("status").alias("target_status"), *[F.col(c) for c in pages.columns if c == "redirects"])
    plain = F.col("target_status") == 200
    if "redirects" in pages.columns:
        plain = plain & (F.coalesce(F.size("redirects"), F.lit(0)) <= 0)
    return declared.join(seen, "target", "left").withColumn("verdict", F.when(F.col("target_status").isNull(), "UNSEEN").when(plain, "PASS").otherwise("FAIL"))


def declared_urls(pages: DataFrame, samples: int = 6) -> DataFrame:
    """Verdicts on canonicals, alternates and sitemap URLs: (rule, verdict, subjects, failed, unseen, examples).

    pages: (url, status, redirects, canonical, hreflang array<struct<lang, href>>, in_sitemap)."""
    known = pages.select("url", "status", "redirects")
    sets = {
        "U1": pages.where("canonical is not null").select("url", F.col("canonical").alias("target")),
        "U2": pages.select("url", F.explode("hreflang").alias("h")).select("url", F.col("h.href").alias("target")).where("target is not null"),
        "U3": pages.where("in_sitemap").select("url", F.col("url").alias("target")),
    }
    rules = pages.sparkSession.createDataFrame([(r,) for r in sets], "rule string")
    rows = None
    for rule, declared in sets.items():
        part = judge_targets(declared, known).select(F.lit(rule).alias("rule"), "target", "verdict")
        rows = part if rows is None else rows.unionByName(part)
    failing = rows.where("verdict = 'FAIL'").select("rule", "target").distinct()
    first = failing.withColumn("_n", F.row_number().over(Window.partitionBy("rule").orderBy("target"))).where(F.col("_n") <= samples)  # tasks keep their first ones only
    examples = first.groupBy("rule").agg(F.array_sort(F.collect_list("target")).alias("examples"))
    more = rows.groupBy("rule").agg(F.count_if(F.col("verdict") == "UNSEEN").alias("unseen")).join(examples, "rule", "left")
    folded = rules.join(fold(rows, ["rule"]), "rule", "left").join(more, "rule", "left")
    return folded.select("rule", F.coalesce("verdict", F.lit("SANS_OBJET")).alias("verdict"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("subjects", "failed", "unseen")], F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))


def drift(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, side, fields): rows that differ, nulls being equal to nulls; a row on one side only differs even where it says nothing."""
    a, b = left.withColumn("_a", F.lit(True)).alias("a"), right.withColumn("_b", F.lit(True)).alias("b")
    met = a.join(b, key, "full")
    side = F.when(F.col("_b").isNull(), "only_left").when(F.col("_a").isNull(), "only_right").otherwise("both")
    changed = F.filter(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in fields]), lambda x: x.isNotNull())
    return met.select(key, side.alias("side"), changed.alias("fields")).where((F.size("fields") > 0) | (F.col("side") != "both"))


def _blank(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(F.coalesce(c.cast("string"), F.lit(""))), '^"+|"+$', "")).isin(*NULL_PLAN)


def measurement_plan(sheets: DataFrame) -> DataFrame:
    """Adds `violations` for sheets that assert something the grid calls non reproducible: a full plan, two runs or more, and a dispersion."""
    subject = not_reproducible(F.col("reserve")) & F.coalesce(F.col("verdict").isin(*AFFIRMATIVE), F.lit(False))
    missing = F.filter(F.array(*[F.when(_blank(F.col(c)), F.lit(c)) for c in PLAN_FIELDS]), lambda x: x.isNotNull())
    runs = F.coalesce(F.regexp_replace(F.col("plan_reexecutions").cast("string"), '"', "").try_cast("int"), F.lit(0))
    rest = F.filter(F.array(F.when(runs < 2, F.lit("fewer than two runs")), F.when(_blank(F.col("dispersion")), F.lit("no dispersion"))), lambda x: x.isNotNull())
    none = F.array().cast("array<string>")
    return sheets.withColumn("violations", F.when(~subject, none).when(F.size(missing) > 0, F.array(F.concat(F.lit("missing: "), F.array_join(missing, ", ")))).otherwise(rest))


def directive_file_read(sheets: DataFrame, file: str = "llms.txt") -> DataFrame:
    """Adds `ok`: a sheet that asserts something of a directive file it names has quoted, counted or declared it absent."""
    subject = F.contains(F.lower(F.coalesce("source_requise", F.lit(""))), F.lit(file)) & F.coalesce(F.col("verdict").isin(*AFFIRMATIVE), F.lit(False)) & F.contains(F.lower(F.coalesce("constat", F.lit(""))), F.lit(file))
    return sheets.withColumn("ok", ~subject | read_evidence(F.col("constat")) | says_absent(F.col("constat")))


def field_evidence(sheets: DataFrame, usable: bool) -> DataFrame:
    """Adds `ok`: an affirmative verdict that needs field data rests on a usable record."""
    from tidewrack.operators.snapshot import needs_field_data

    subject = needs_field_data(F.col("source_requise")) & F.coalesce(F.col("verdict").isin(*AFFIRMATIVE), F.lit(False))
    return sheets.withColumn("ok", ~subject | F.lit(usable))


#: How a source says that a connector read it and on which day, and how dates are written.
CONNECTOR, READ_ON, ISO_DATE = "connecteur", r"\blue?\s+le\s+\d{4}-\d{2}-\d{2}\b", r"\b(\d{4}-\d{2}-\d{2})\b"


def connector_metrics(metrics: DataFrame) -> DataFrame:
    """Adds `violations`: a metric read by connector is T1, and its source gives the day it was read and the period, three dates in all."""
    source = F.coalesce("source", F.lit(""))
    dated = source.rlike(f"(?iU){READ_ON}")
    found = F.array(F.when(F.coalesce(F.col("preuve"), F.lit("")) != "T1", F.lit("tier is not T1")), F.when(~dated, F.lit("no read date")), F.when(F.size(F.regexp_extract_all(source, F.lit(ISO_DATE), 1)) < 3, F.lit("no period")))
    subject = F.contains(F.lower(source), F.lit(CONNECTOR))
    return metrics.withColumn("violations", F.when(subject, F.filter(found, lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>")))


def unknown_nodes(bridge: DataFrame, nodes: DataFrame, key: str = "node") -> DataFrame:
    return bridge.join(nodes.select(key), key, "left_anti")


def contiguous(nodes: DataFrame, key: str = "id") -> DataFrame:
    """(ok, n, lowest, highest): ids run from 1 without a gap or a repeat."""
    out = nodes.agg(F.count("*").alias("n"), F.count_distinct(key).alias("d"), F.min(key).alias("lowest"), F.max(key).alias("highest"))
    return out.select(((F.col("n") == F.col("d")) & (F.col("lowest") == 1) & (F.col("highest") == F.col("n"))).alias("ok"), "n", "lowest", "highest")


def resolve_duplicates(nodes: DataFrame) -> DataFrame:
    """Each node that points to another (doublon_de) with that node's branch; an unknown name is an error."""
    a, b = nodes.where("doublon_de is not null"), nodes.where("doublon_de is null").select(F.lower("noeud").alias("_n"), F.col("branche").alias("authority"))
    met = a.join(b, F.lower(a["doublon_de"]) == b["_n"], "left").drop("_n")
    return met.withColumn("authority", F.coalesce("authority", F.raise_error(F.concat(F.lit("no node is named "), F.col("doublon_de"))).cast("string")))
