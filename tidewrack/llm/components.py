"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.llm.common import WorkArea


def connected_components(edges: DataFrame, work: WorkArea, name: str = "cc", max_rounds: int = 60) -> DataFrame:
    """(a, b) long edges -> (node, root): root is the smallest node reachable; a root itself and nodes without an edge to another are left out.

    Each round writes its edges to the shared folder, so lineage stays one round long. A node with very many
    neighbours meets one row of minima, a join that adaptive execution can split."""
    current = work.write(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0", rows=edges.count())
    rows = current.count()
    before = None
    for i in range(1, max_rounds + 1):
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        small = small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        nxt = work.write(small, f"{name}-{i}", rows=2 * rows)
        seen = nxt.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        work.drop(f"{name}-{i - 1}")
        current = nxt
        if tuple(seen) == before:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before, rows = tuple(seen), seen[0]
    raise RuntimeError("components did not settle")
