"""Directed jumps from page to page: redirect chains from single hops, and circles of pages.

Chains are followed by pointer doubling: a round joins each page's place with the place of where it stands, so 2 ** k hops
are done after k rounds, whatever the number of chains. Circles of general links (crossed canonicals, alternates that name
each other) are strongly connected components: pages with no link in or none out are trimmed again and again, then the least
page that reaches each page is spread forwards, and each such page's own circle is found backwards. Each round is a
join of the rows that are left, written to the folder that the cluster shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.functions import urls
from tidewrack.operators.graph import cut_lineage

REDIRECTS = (301, 302, 303, 307, 308)


def redirect_hops(responses: DataFrame) -> DataFrame:
    """(url, status, location): the answers that send on, with their target as a whole URL. responses: (url, status, location)."""
    sent = responses.where(F.col("status").isin(*REDIRECTS) & (F.coalesce("location", F.lit("")) != ""))
    return sent.select("url", "status", urls.resolve(F.col("url"), F.col("location")).alias("location"))


def follow(hops: DataFrame) -> DataFrame:
    """(url, final, hops, loop, chain) for each url of (url, location, status): where it ends, after how many hops, and
    each hop's "status → location"; a url whose chain comes back to itself or leads into such a chain has a null final and hops,
    and of its chain the part up to the first repetition at least.

    Of several hops from one url the least location counts. Rounds: the logarithm of the longest chain, and one more."""
    step = F.concat_ws(" → ", F.col("status").cast("string"), F.col("location"))
    once = hops.where("url is not null and location is not null").groupBy("url").agg(F.min(F.struct("location", step.alias("step"))).alias("m"))
    state = cut_lineage(once.select("url", F.col("m.location").alias("at"), F.lit(1).cast("long").alias("n"), F.array("m.step").alias("chain")))
    ended = None
    while True:
        there = state.select(F.col("url").alias("of"), F.col("at").alias("beyond"), F.col("n").alias("more"), F.col("chain").alias("rest"))
        # Where a page stands on a page without a hop of its own, or on one that was found to end, its chain has ended.
        if ended is not None:
            done = ended.select(F.col("url").alias("of"), F.col("at").alias("beyond"), F.col("n").alias("more"), F.col("chain").alias("rest"))
            there = there.withColumn("over", F.lit(False)).unionByName(done.withColumn("over", F.lit(True)))
        else:
            there = there.withColumn("over", F.lit(False))
        met = state.join(there, F.col("at") == F.col("of"), "left").select(
            "url", F.coalesce("beyond", "at").alias("at"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"),
            F.concat("chain", F.coalesce("rest", F.array().cast("array<string>"))).alias("chain"), F.coalesce("over", F.lit(True)).alias("over"),
        )
        met = cut_lineage(met)
        fresh = met.where("over").drop("over")
        left = met.where("not over").drop("over")
        counts = met.agg(F.count_if("over").alias("over"), F.count("*").alias("all")).first()
        ended = fresh if ended is None else ended.unionByName(fresh)
        if counts["over"] == counts["all"]:
            left = None
            break
        if counts["over"] == 0:  # a chain of any length would have lost its last half: what is left goes round
            break
        state = left
    out = ended.select("url", F.col("at").alias("final"), F.col("n").alias("hops"), F.lit(False).alias("loop"), "chain")
    if left is None:
        return out
    seen = F.array_distinct("chain")
    return out.unionByName(left.select("url", F.lit(None).cast("string").alias("final"), F.lit(None).cast("long").alias("hops"), F.lit(True).alias("loop"), seen.alias("chain")))


def fetched(responses: DataFrame) -> DataFrame:
    """(url, code, final_url, body, chain, loop) for each first answer of (url, status, location, body): what a client that follows redirects gets.

    A chain whose last page was never answered has the code 0; one that goes round has the status of its own hop and no body."""
    first = responses.groupBy("url").agg(F.min(F.struct("status", "location", "body")).alias("a")).select("url", "a.*")
    chains = follow(redirect_hops(first)).select(F.col("url").alias("of"), "final", "loop", "chain")
    met = first.join(chains, F.col("url") == F.col("of"), "left").withColumn("end", F.coalesce("final", "url"))
    last = first.select(F.col("url").alias("end_url"), F.col("status").alias("end_status"), F.col("body").alias("end_body"))
    met = met.join(last, F.col("end") == F.col("end_url"), "left")
    loop, empty = F.coalesce("loop", F.lit(False)), F.lit(b"")
    body = F.when(loop | (F.coalesce("end_status", F.lit(0)) >= 400), empty).otherwise(F.coalesce("end_body", empty))
    return met.select("url", F.coalesce("end_status", F.lit(0)).alias("code"), F.col("end").alias("final_url"), body.alias("body"), F.coalesce("chain", F.array().cast("array<string>")).alias("chain"), loop.alias("loop"))


def chain_findings(chains: DataFrame, most: int = 2) -> DataFrame:
    """Adds verdict to (url, hops, loop): loop, too-long beyond `most` hops, or ok."""
    return chains.withColumn("verdict", F.when(F.col("loop"), "loop").when(F.col("hops") > most, "too-long").otherwise("ok"))


# --- circles ---------------------------------------------------------------------------------------------------


def trimmed(edges: DataFrame) -> DataFrame:
    """The links of (src, dst) that lie between pages with a link in and one out, again and again until none goes: what can lie on a circle."""
    now = cut_lineage(edges)
    n = now.count()
    while n:
        inner = now.select("src").distinct().intersect(now.select("dst").distinct()).withColumnRenamed("src", "node")
        kept = cut_lineage(now.join(inner, F.col("src") == F.col("node"), "left_semi").join(inner, F.col("dst") == F.col("node"), "left_semi"))
        left = kept.count()
        if left == n:
            break
        now, n = kept, left
    return now


def _spread(edges: DataFrame, colour: DataFrame) -> DataFrame:
    """(node, colour): the least colour among a node's own and those of the nodes that reach it."""
    while True:
        given = edges.join(colour, edges["src"] == colour["node"]).groupBy(F.col("dst").alias("of")).agg(F.min("colour").alias("less"))
        met = colour.join(given, F.col("node") == F.col("of"), "left")
        lower = F.coalesce(F.col("less") < F.col("colour"), F.lit(False))
        new = cut_lineage(met.select("node", F.when(lower, F.col("less")).otherwise(F.col("colour")).alias("colour"), lower.alias("changed")))
        colour = new.select("node", "colour")
        if new.where("changed").isEmpty():
            return colour


def _back(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, colour): the nodes that lead to the root of their own colour, over links within the colour."""
    found = frontier = cut_lineage(roots)
    while True:
        reached = edges.join(frontier, (edges["dst"] == frontier["node"]) & (edges["colour"] == frontier["colour"])).select(F.col("src").alias("node"), edges["colour"]).distinct()
        frontier = cut_lineage(reached.join(found.select("node"), "node", "left_anti"))
        if frontier.isEmpty():
            return found
        found = cut_lineage(found.unionByName(frontier))


def circles(edges: DataFrame) -> DataFrame:
    """(node, component, size) of the strongly connected components of more than one node of (src, dst); component is the least node.

    A link of a page to itself makes no circle."""
    rest = edges.select("src", "dst").where("src is not null and dst is not null and src <> dst").distinct()
    out = None
    while True:
        rest = trimmed(rest)
        if rest.isEmpty():
            break
        nodes = rest.select(F.col("src").alias("node")).distinct()
        colour = _spread(rest, nodes.withColumn("colour", F.col("node")))
        a, b = colour.select(F.col("node").alias("src"), F.col("colour").alias("a")), colour.select(F.col("node").alias("dst"), F.col("colour").alias("b"))
        inside = cut_lineage(rest.join(a, "src").join(b, "dst").where("a = b").select("src", "dst", F.col("a").alias("colour")))
        found = _back(inside, colour.where("node = colour"))
        out = found if out is None else out.unionByName(found)
        # Within a colour, the root's component is done; links that touch it lie on no other circle.
        gone = found.select("node")
        left = inside.select("src", "dst").join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
        rest = left
    if out is None:
        kind = dict(edges.dtypes)["src"]
        return edges.sparkSession.createDataFrame([], f"node {kind}, component {kind}, size long")
    size = out.groupBy(F.col("colour").alias("component")).agg(F.count("*").alias("size"), F.min("node").alias("least")).where("size > 1")
    return out.join(size, F.col("colour") == F.col("component")).select("node", F.col("least").alias("component"), "size")


def crossed(pages: DataFrame, url: str = "url", target: str = "canonical") -> DataFrame:
    """(url, component, size): pages whose canonicals lead back to them by way of another page."""
    named: Column = urls.resolve(F.col(url), F.col(target))
    whole = cut_lineage(pages.where(F.col(target).isNotNull()).select(F.col(url).alias("src"), named.alias("dst")))  # else one expression gets too long to compile
    links = whole.select(urls.normalise(F.col("src")).alias("src"), urls.normalise(F.col("dst")).alias("dst"))
    return circles(links).withColumnRenamed("node", "url")
