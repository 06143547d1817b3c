"""Link graphs: click depth, orphans, in-degree, coverage gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.session import shared_folder

#: A crawl queues so many times its page cap at most.
QUEUE_FACTOR = 5


def cut_lineage(df: DataFrame) -> DataFrame:
    """Ends the lineage with a reliable checkpoint in the folder that the cluster shares."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def click_depth(edges: DataFrame, root: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, depth): links from the roots to each reachable node.

    edges: (src, dst); root: (node). One join of the frontier with the edges for each level. A level writes its own
    nodes and nothing else; the visited set is the union of what the levels wrote."""
    edges = cut_lineage(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    frontier = cut_lineage(root.select("node").distinct().withColumn("depth", F.lit(0)))
    visited, depth = frontier, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        reached = edges.join(frontier, edges["src"] == frontier["node"]).select(F.col("dst").alias("node")).distinct()
        frontier = cut_lineage(reached.join(visited, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited


def crawl(edges: DataFrame, root: DataFrame, cap: int, blocked: DataFrame | None = None, declared: DataFrame | None = None) -> DataFrame:
    """(node, depth, found_by, visited): what a crawl of at most `cap` pages reaches, level by level, and what it knows of but leaves.

    Pages that robots rules forbid (blocked: node) are known and never visited. Of a level that does not fit, the first
    pages by name are visited. No more than QUEUE_FACTOR x cap pages are queued; links found beyond that are not followed.
    Declared pages that links do not reach come last, with a null depth."""
    links = cut_lineage(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    forbidden = root.select("node").where("false") if blocked is None else blocked.select("node").distinct()
    none = F.lit(None).cast("int")

    def level(nodes: DataFrame, depth: Column, found_by: str, left: int) -> DataFrame:
        """Nodes with whether they are visited: the first `left` that are not forbidden."""
        may = nodes.select("node").join(forbidden, "node", "left_anti").orderBy("node").limit(left).withColumn("visited", F.lit(True))
        met = nodes.select("node").join(may, "node", "left")
        return cut_lineage(met.select("node", depth.alias("depth"), F.lit(found_by).alias("found_by"), F.coalesce("visited", F.lit(False)).alias("visited")))

    known, used, queued = None, 0, 0
    todo = root.select("node").distinct()
    for found_by in ("link", "declared"):
        depth = 0
        while not todo.isEmpty():
            front = level(todo, F.lit(depth) if found_by == "link" else none, found_by, max(cap - used, 0))
            known = front if known is None else known.unionByName(front)
            n = front.agg(F.count_if("visited").alias("v"), F.count("*").alias("n")).first()
            used, queued, depth = used + n["v"], queued + n["n"], depth + 1
            if used >= cap or n["v"] == 0:
                break
            reached = links.join(front.where("visited"), links["src"] == front["node"]).select(F.col("dst").alias("node")).distinct()
            todo = cut_lineage(reached.join(known.select("node"), "node", "left_anti").orderBy("node").limit(max(QUEUE_FACTOR * cap - queued, 0)))
        if found_by == "declared" or declared is None or known is None:
            break
        todo = declared.select("node").distinct().join(known.select("node"), "node", "left_anti")
    return known if known is not None else todo.select("node", none.alias("depth"), F.lit("link").alias("found_by"), F.lit(False).alias("visited"))


def two_phase(edges: DataFrame, root: DataFrame, declared: DataFrame) -> DataFrame:
    """(node, depth, found_by): pages reached by links with their depth; then declared pages that links do not
    reach, and what only they lead to, with a null depth."""
    linked = click_depth(edges, root).withColumn("found_by", F.lit("link"))
    rest = declared.select("node").distinct().join(linked, "node", "left_anti")
    later = click_depth(edges, rest).join(linked, "node", "left_anti")
    return linked.unionByName(later.select("node", F.lit(None).cast("int").alias("depth"), F.lit("declared").alias("found_by")))


def in_degree(edges: DataFrame, contextual: str | None = None) -> DataFrame:
    """(node, links, contextual_links): every link counts, repeated ones and self links too."""
    own = F.count_if(F.col(contextual)) if contextual else F.count("*")
    return edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("links"), own.alias("contextual_links"))


def with_in_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with their links in; a node that no link names has 0, which is a measure and not a gap."""
    found = in_degree(edges).select("node", "links")
    return nodes.join(found, "node", "left").withColumn("links", F.coalesce("links", F.lit(0)))


def orphans(declared: DataFrame, edges: DataFrame, root: Column | None = None) -> DataFrame:
    """Declared nodes that no link names; the root is none."""
    out = declared.join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")
    return out if root is None else out.where(F.col("node") != root)


def unreached(declared: DataFrame, reached: DataFrame) -> DataFrame:
    return declared.join(reached, "node", "left_anti")


def coverage(known: DataFrame, visited: DataFrame, blocked: DataFrame | None = None, cap: int | None = None) -> DataFrame:
    """(complete, unvisited, reason): whether every known node was visited, and if not, why not.

    Nodes that robots rules forbid and nodes behind a page cap have reasons of their own."""
    left = known.select("node").distinct().join(visited.select("node"), "node", "left_anti")
    if blocked is not None:
        left = left.join(blocked.select("node", F.lit(True).alias("_b")).distinct(), "node", "left")
    else:
        left = left.withColumn("_b", F.lit(None).cast("boolean"))
    n, b = F.count("*"), F.count("_b")
    reason = F.when(n == 0, F.lit(None)).when(n == b, "blocked_by_robots").when(b > 0, "cap_reached_and_blocked_by_robots").otherwise("cap_reached" if cap else "not_visited")
    return left.agg((n == 0).alias("complete"), n.alias("unvisited"), reason.alias("reason"))


def gated(value: Column, complete: Column) -> Column:
    """The value where coverage is complete, else null: a partial crawl measures no graph counter."""
    return F.when(complete, value)


def silo_cohesion(edges: DataFrame, silo: DataFrame) -> DataFrame:
    """Share of each silo's links that stay in it. silo: (node, silo)."""
    a, b = silo.select(F.col("node").alias("src"), F.col("silo").alias("from_silo")), silo.select(F.col("node").alias("dst"), F.col("silo").alias("to_silo"))
    met = edges.join(a, "src").join(b, "dst")
    return met.groupBy("from_silo").agg(F.count("*").alias("links"), (F.count_if(F.col("from_silo") == F.col("to_silo")) / F.count("*")).alias("share_inside"))


def silo_counts(edges: DataFrame, silo: DataFrame, contextual: str = "contextual", out_least: int = 5, in_least: int = 3) -> DataFrame:
    """(node, silo, pillar, inside_out, contextual_in, ok): a pillar links to `out_least` pages of its silo, a satellite gets
    `in_least` contextual links from it. silo: (node, silo, pillar)."""
    a, b = silo.select(F.col("node").alias("src"), F.col("silo").alias("a")), silo.select(F.col("node").alias("dst"), F.col("silo").alias("b"))
    inside = edges.join(a, "src").join(b, "dst").where("a = b and src <> dst")
    out = inside.groupBy(F.col("src").alias("node")).agg(F.count_distinct("dst").alias("inside_out"))
    into = inside.where(F.col(contextual)).groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("contextual_in"))
    met = silo.join(out, "node", "left").join(into, "node", "left").fillna(0, ["inside_out", "contextual_in"])
    return met.withColumn("ok", F.when(F.col("pillar"), F.col("inside_out") >= out_least).otherwise(F.col("contextual_in") >= in_least))


def closure(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Nodes that the starts lead to, themselves left out unless a cycle returns."""
    seeds = edges.join(starts.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
    return click_depth(edges, seeds).select("node")
