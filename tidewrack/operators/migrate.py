"""Versions of the node grid: chains of evolutions, ids across them, and refusals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.operators.graph import cut_lineage


def chains(arcs: DataFrame, start: str) -> DataFrame:
    """(version, hops, path): the shortest chain from a version to each one it leads to, itself by the empty one.

    The registry is a few rows for each version; of equal chains the first by name is taken."""
    spark = arcs.sparkSession
    out = spark.createDataFrame([(start, 0, [start])], "version string, hops int, path array<string>")
    frontier, hop = out, 0
    while True:
        hop += 1
        step = frontier.join(arcs, frontier["version"] == arcs["de"]).select(F.col("vers").alias("version"), F.lit(hop).alias("hops"), F.concat("path", F.array("vers")).alias("path"))
        step = step.groupBy("version", "hops").agg(F.min("path").alias("path")).join(out.select("version"), "version", "left_anti")
        step = cut_lineage(step)
        if step.isEmpty():
            return out
        out, frontier = out.unionByName(step), step


def _mapped(old: Column, moves: dict[int, int]) -> Column:
    if not moves:
        return old
    pairs = F.create_map(*[F.lit(x) for p in sorted(moves.items()) for x in p])
    return F.coalesce(F.try_element_at(pairs, old), old)


def compose(ids: DataFrame, evolutions: list[tuple[dict[int, int], list[int]]], key: str = "id") -> DataFrame:
    """(id, new_id) after each evolution (moves, retired) in turn; an id that is retired on the way is left out.

    Evolutions are a small registry, so each becomes a map in the projection and not a join."""
    out = ids.select(F.col(key).alias("id"), F.col(key).cast("int").alias("new_id"))
    for moves, retired in evolutions:
        if retired:
            out = out.where(~F.col("new_id").isin(*retired))
        out = out.withColumn("new_id", _mapped(F.col("new_id"), moves))
    return out


def new_ids(evolutions: list[tuple[dict[int, int], list[int], list[int]]]) -> list[int]:
    """Ids that the evolutions (moves, retired, new) added, as later ones number them."""
    out: list[int] = []
    for moves, retired, added in evolutions:
        out = [moves.get(i, i) for i in out if i not in retired] + list(added)
    return out


def retired_in_origin(evolutions: list[tuple[dict[int, int], list[int]]]) -> list[int]:
    """Retired ids as the first version numbers them."""
    out: list[int] = []
    for n, (_, retired) in enumerate(evolutions):
        for i in retired:
            for moves, _r in reversed(evolutions[:n]):
                i = {v: k for k, v in moves.items()}.get(i, i)
            out.append(i)
    return out


def collisions(mapping: DataFrame) -> DataFrame:
    """New ids that several old ones come to."""
    return mapping.groupBy("new_id").agg(F.count_distinct("id").alias("n")).where("n > 1")


def holes(mapping: DataFrame, known: DataFrame, added: DataFrame) -> DataFrame:
    """Ids of the target version that no old id comes to and that no evolution added: nobody explains them."""
    return known.select("id").join(mapping.select(F.col("new_id").alias("id")), "id", "left_anti").join(added.select("id"), "id", "left_anti")


def ambiguous(mapping: DataFrame) -> DataFrame:
    """Old ids that a registry sends to several new ones."""
    return mapping.groupBy("id").agg(F.count_distinct("new_id").alias("n")).where("n > 1")


def refusals(sheets: DataFrame, mapping: DataFrame, known: DataFrame, chain_found: bool) -> DataFrame:
    """(reason, id) rows; a migration is applied only if there is none.

    sheets: (id as text, has_work); mapping: (id, new_id); known: (id) of the target version."""
    if not chain_found:
        return sheets.sparkSession.createDataFrame([("unknown_version", None)], "reason string, id string")
    read = sheets.withColumn("n", F.col("id").try_cast("int"))
    bad = read.where("n is null").select(F.lit("unreadable_id").alias("reason"), "id")
    moved = read.where("n is not null").join(mapping.select(F.col("id").alias("n"), "new_id"), "n", "left")
    lost = moved.where("new_id is null and has_work").select(F.lit("retired_or_orphan_with_work").alias("reason"), "id")
    out = moved.where("new_id is not null").join(known.select(F.col("id").alias("new_id")), "new_id", "left_anti").select(F.lit("unknown_target").alias("reason"), "id")
    twice = moved.where("new_id is not null").groupBy("new_id").agg(F.count("*").alias("c"), F.min("id").alias("id")).where("c > 1").select(F.lit("collision").alias("reason"), "id")
    return bad.unionByName(lost).unionByName(out).unionByName(twice)


def criterion_drift(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Nodes whose question, method or criterion reads otherwise, blanks aside: (key, fields)."""
    plain = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    met = old.alias("o").join(new.alias("n"), key)
    changed = F.filter(F.array(*[F.when(plain(F.col(f"o.{c}")) != plain(F.col(f"n.{c}")), F.lit(c)) for c in fields]), lambda x: x.isNotNull())
    return met.select(key, changed.alias("fields")).where(F.size("fields") > 0)


def cited_moves(texts: DataFrame, text: str, moves: dict[int, int]) -> DataFrame:
    """Adds `moved` and `ranges`: cited node ids that move, and cited ranges, which are flagged and never rewritten."""
    cited = F.regexp_extract_all(F.col(text), F.lit(r"(?i)(?:nœud|noeud|node)s?\s+(\d{1,3})(?!\d|\s*-\s*\d)"), 1)
    ranges = F.regexp_extract_all(F.col(text), F.lit(r"(?i)(?:nœud|noeud|node)s?\s+(\d{1,3}\s*-\s*\d{1,3})"), 1)
    moved = F.filter(F.transform(cited, lambda x: x.cast("int")), lambda x: x.isin(*moves)) if moves else F.array().cast("array<int>")
    return texts.withColumn("moved", moved).withColumn("ranges", ranges)


def lossless(before: DataFrame, after: DataFrame, ignore: list[str]) -> bool:
    """Whether two tables hold the same rows, some columns aside: no row is only on one side."""
    columns = [c for c in before.columns if c not in ignore]
    side = lambda df, n: df.select(*columns, F.lit(n).alias("_side"))
    both = side(before, 1).unionAll(side(after, -1))  # each side is read once
    return both.groupBy(*columns).agg(F.sum("_side").alias("_left")).where("_left <> 0").isEmpty()


def refuse_filled(spark: SparkSession, path: str) -> None:
    """Raises if there is anything at a path: a migration writes to a new place only."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(place) and (fs.getFileStatus(place).isFile() or len(fs.listStatus(place))):
        raise ValueError(f"the target is not empty: {path}")


def write_migrated(sheets: DataFrame, path: str, told: DataFrame) -> None:
    """Writes migrated sheets to an empty place if nothing was refused. told: the rows of `refusals`."""
    refuse_filled(sheets.sparkSession, path)
    reasons = told.groupBy("reason").agg(F.count("*").alias("n"), F.min("id").alias("id")).orderBy("reason").collect()  # a row for each kind of reason
    if reasons:
        raise ValueError("the migration is refused: " + ", ".join(f"{r['reason']} ({r['n']}, first {r['id']})" for r in reasons))
    sheets.write.parquet(path)
