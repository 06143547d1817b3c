"""Checks of the reference data and of a study: each gives its offending rows, and all of them one table of facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.functions.text import slug

#: Nodes and branches of the grid, sections of a sheet.
NODES, BRANCHES = 89, 17
SECTIONS = ("Constat", "Interprétation", "Preuves", "Actions")
SLUG = r"^[a-z0-9]+(-[a-z0-9]+)*$"


def facts(offending: dict[str, DataFrame], samples: int = 5) -> DataFrame:
    """(name, ok, n, examples): how many rows break each check, and the first of them. Each table has a column `subject`."""
    parts = [df.select(F.lit(name).alias("name"), F.col("subject").cast("string").alias("subject")) for name, df in offending.items()]
    rows = reduce(DataFrame.unionByName, parts)
    place = F.row_number().over(Window.partitionBy("name").orderBy("subject"))
    # The filter on the place lets every task keep its own first rows only, before any check's rows come together.
    first = rows.withColumn("_n", place).where(F.col("_n") <= samples).groupBy("name").agg(F.array_sort(F.collect_list("subject")).alias("examples"))
    found = rows.groupBy("name").agg(F.count("*").alias("n"))
    names = rows.sparkSession.createDataFrame([(n,) for n in offending], "name string")
    out = names.join(found, "name", "left").join(first, "name", "left")
    return out.select("name", F.col("n").isNull().alias("ok"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))


def wrong_counts(nodes: DataFrame, total: int = NODES, branches: int = BRANCHES) -> DataFrame:
    """Counts of nodes and branches that are not those of the grid."""
    got = nodes.agg(F.count("*").alias("nodes"), F.count_distinct("branche").alias("branches"))
    told = F.array(F.when(F.col("nodes") != total, F.concat(F.lit("nodes: "), "nodes")), F.when(F.col("branches") != branches, F.concat(F.lit("branches: "), "branches")))
    return got.select(F.explode(F.filter(told, lambda x: x.isNotNull())).alias("subject"))


def scattered_branches(nodes: DataFrame) -> DataFrame:
    """Branches whose ids do not stand together: another branch's id lies between their first and their last."""
    own = nodes.groupBy("branche").agg(F.min("id").alias("a"), F.max("id").alias("z"), F.count_distinct("id").alias("n"))
    return own.where(F.col("z") - F.col("a") + 1 != F.col("n")).select(F.col("branche").alias("subject"))


def bad_slugs(nodes: DataFrame, name: str = "noeud", slug_: str = "slug_noeud") -> DataFrame:
    """Slugs of a wrong form, or that are not made from their name."""
    return nodes.where(~F.col(slug_).rlike(SLUG) | (F.col(slug_) != slug(F.col(name)))).select(F.col(slug_).alias("subject"))


def client_data(texts: DataFrame, text: str, names: list[str], path: str = "path") -> DataFrame:
    """Reference texts that mention a client, in any case, as a whole word."""
    if not names:
        return texts.where("false").select(F.col(path).alias("subject"))
    words = "|".join(rf"\Q{n}\E" for n in names)
    return texts.where(F.col(text).rlike(rf"(?i)(?<![\p{{L}}\d])(?:{words})(?![\p{{L}}\d])")).select(F.col(path).alias("subject"))


def out_of_bounds(rows: DataFrame, key: str, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """(subject): key and field of values outside their bounds; a missing value is out of none."""
    told = F.array(*[F.when(~F.col(c).between(a, b), F.concat(F.col(key).cast("string"), F.lit(f".{c}"))) for c, (a, b) in bounds.items()])
    return rows.select(F.explode(F.filter(told, lambda x: x.isNotNull())).alias("subject"))


def empty_folders(folders: DataFrame, files: DataFrame) -> DataFrame:
    """Folders that no file lies below. folders: (path); files: (path)."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    held = files.where(F.contains("path", F.lit("/"))).select(F.explode(above).alias("path")).distinct()
    return folders.join(held, "path", "left_anti").select(F.col("path").alias("subject"))


def other_versions(declared: DataFrame, current: str, path: str = "path") -> DataFrame:
    """Files that declare another version than the current one."""
    return declared.where(~F.col("version").eqNullSafe(F.lit(current))).select(F.col(path).alias("subject"))


def stale_registry(registry: DataFrame, current: str) -> DataFrame:
    """Versions at which the chain of evolutions ends that are not the current one, and versions that it leaves twice."""
    ends = registry.select(F.col("vers").alias("subject")).distinct().join(registry.select(F.col("de").alias("subject")), "subject", "left_anti").where(F.col("subject") != current)
    return ends.unionByName(registry.groupBy(F.col("de").alias("subject")).agg(F.count("*").alias("n")).where("n > 1").select("subject"))


def wrong_summaries(summary: DataFrame, rows: DataFrame, group: str, told: str = "n") -> DataFrame:
    """Groups whose count in a summary is not the count of their rows, on either side."""
    counted = rows.groupBy(group).agg(F.count("*").alias("_n"))
    met = summary.select(group, told).join(counted, group, "full")
    return met.where(F.coalesce(told, F.lit(0)) != F.coalesce("_n", F.lit(0))).select(F.col(group).alias("subject"))


def unlisted_sources(nodes: DataFrame, matrix: DataFrame, source: str = "source_requise") -> DataFrame:
    """Sources that nodes need and the matrix does not list, and sources listed that no node needs."""
    a, b = nodes.where(F.col(source).isNotNull()).select(F.col(source).alias("subject")).distinct(), matrix.select(F.col(source).alias("subject")).distinct()
    return a.join(b, "subject", "left_anti").unionByName(b.join(a, "subject", "left_anti"))


def sheets_off_tree(nodes: DataFrame, files: DataFrame, key: str = "chemin") -> DataFrame:
    """Nodes without a sheet, and sheets without a node."""
    a, b = nodes.select(F.col(key).alias("subject")).distinct(), files.select(F.col(key).alias("subject")).distinct()
    return a.join(b, "subject", "left_anti").unionByName(b.join(a, "subject", "left_anti"))


def missing_sections(sheets: DataFrame, key: str, text: str, sections: tuple[str, ...] = SECTIONS) -> DataFrame:
    """(subject): key and section of the level-two headings that a sheet lacks."""
    absent = F.array(*[F.when(~F.col(text).rlike(rf"(?:\A|\n)##[ \t]+\Q{s}\E[ \t]*(?:\n|\z)"), F.concat(F.col(key).cast("string"), F.lit(f": {s}"))) for s in sections])
    return sheets.select(F.explode(F.filter(absent, lambda x: x.isNotNull())).alias("subject"))


def wrong_counters(counters: DataFrame, counted: DataFrame) -> DataFrame:
    """Counters of a snapshot that differ from those counted on the sheets; both have one row and the same columns."""
    told = lambda df, name: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("subject"), F.col(c).cast("long").alias(name)) for c in df.columns])).alias("x")).select("x.*")
    met = told(counters, "a").join(told(counted, "b"), "subject", "full")
    return met.where(~F.col("a").eqNullSafe(F.col("b"))).select("subject")


def not_transposable(versions: DataFrame, chains: DataFrame) -> DataFrame:
    """Studies whose grid version no chain of evolutions leads on from. versions: (subject, version); chains: (version)."""
    return versions.join(chains.select("version"), "version", "left_anti").select("subject")


def bare_projections(texts: DataFrame, text: str, key: str) -> DataFrame:
    """Projected figures that name no source: a line with a currency or a percentage and no bracketed reference."""
    lines = texts.select(F.col(key).alias("k"), F.posexplode(F.split(text, r"\r?\n")).alias("n", "line"))
    figure: Column = F.col("line").rlike(r"\d\s*(?:€|%)") & ~F.col("line").rlike(r"\[[^\]]+\]")
    return lines.where(figure).select(F.concat(F.col("k").cast("string"), F.lit(":"), F.col("n") + 1).alias("subject"))
