"""Sitemaps and robots rules, from tables of fetched files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.functions import urls
from tidewrack.operators.graph import cut_lineage

MOST_FILES = 25


def declared_by_robots(robots: DataFrame) -> DataFrame:
    """(host, sitemap): Sitemap lines of (host, body), or /sitemap.xml where a host has none."""
    lines = F.regexp_extract_all("body", F.lit(r"(?im)^\s*sitemap\s*:\s*(\S+)"), 1)
    default = F.array(F.concat(F.lit("https://"), "host", F.lit("/sitemap.xml")))
    return robots.select("host", F.explode(F.when(F.size(lines) > 0, lines).otherwise(default)).alias("sitemap"))


def locations(files: DataFrame) -> DataFrame:
    """(sitemap, is_index, loc) of fetched (sitemap, body)."""
    loc = F.explode(F.regexp_extract_all("body", F.lit(r"(?is)<loc>\s*(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?\s*</loc>"), 1))
    return files.select("sitemap", F.col("body").rlike(r"(?i)<sitemapindex").alias("is_index"), loc.alias("loc"))


def named_files(robots: DataFrame, files: DataFrame, most: int = MOST_FILES) -> DataFrame:
    """(host, sitemap, place): the sitemap files that a host's own declarations name, indexes followed to any depth, in the order of reading.

    The rounds end when no new file is named."""
    queue = declared_by_robots(robots).distinct().withColumn("_round", F.lit(0))
    seen, found = queue, locations(files)
    depth = 0
    while True:
        depth += 1
        deeper = queue.join(found.where("is_index"), "sitemap").select("host", F.col("loc").alias("sitemap")).distinct()
        queue = cut_lineage(deeper.join(seen, ["host", "sitemap"], "left_anti").withColumn("_round", F.lit(depth)))
        if queue.isEmpty():
            break
        seen = seen.unionByName(queue)
    return seen.select("host", "sitemap", F.row_number().over(Window.partitionBy("host").orderBy("_round", "sitemap")).alias("place"))


def declared_urls(robots: DataFrame, files: DataFrame, most: int = MOST_FILES) -> DataFrame:
    """(host, url): URLs of a host's own sitemaps, of at most `most` files for each host; unread() says what that leaves."""
    read = named_files(robots, files, most).where(F.col("place") <= most)
    url = urls.percent_decode(F.replace("loc", F.lit("&amp;"), F.lit("&")))
    out = read.join(locations(files).where("not is_index"), "sitemap").select("host", urls.normalise(url).alias("url"))
    return out.where(urls.host(F.col("url")) == F.col("host")).distinct()


def unread(robots: DataFrame, files: DataFrame, most: int = MOST_FILES) -> DataFrame:
    """(host, files, unread, complete): hosts whose files were not all read have no count of declared URLs, but a lower bound."""
    out = named_files(robots, files, most).groupBy("host").agg(F.count("*").alias("files"), F.count_if(F.col("place") > most).alias("unread"))
    return out.withColumn("complete", F.col("unread") == 0)


def robots_rules(robots: DataFrame) -> DataFrame:
    """(host, group_no, agents, rules array<struct<position, allow, path>>): the groups of (host, body) that have a rule or a pace, in their order.

    Lines that name agents and follow each other begin a group, and the rules behind them are its own; a blank line ends it, and
    what stands outside a group says nothing. Comments go; agents and paths are decoded; an empty Disallow allows everything."""
    lines = robots.select("host", F.posexplode(F.split("body", r"\r\n|\r|\n", -1)).alias("position", "line"))
    bare = lambda c: F.btrim(c, F.lit(" \t\x0b\x0c"))
    plain = bare(F.regexp_replace("line", "#.*$", ""))
    name, value = F.lower(bare(F.regexp_extract(plain, r"^([^:]*):", 1))), urls.percent_decode(bare(F.regexp_extract(plain, r"^[^:]*:(.*)$", 1)))
    kind = F.when(F.col("line") == "", "blank").when(name == "user-agent", "agent").when(name.isin("allow", "disallow"), "rule").when(name.isin("crawl-delay", "request-rate"), "pace")
    # A line that is a comment alone, or of another name, leaves the group as it is.
    rows = lines.select("host", "position", kind.alias("kind"), (name == "allow").alias("allow"), value.alias("value")).where("kind is not null")
    order = Window.partitionBy("host").orderBy("position")
    begins = (F.col("kind") == "blank") | ((F.col("kind") == "agent") & ~F.lag("kind").over(order).eqNullSafe(F.lit("agent")))
    marked = rows.withColumn("begins", begins.cast("int"))
    grouped = marked.withColumn("group_no", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rule = F.when(F.col("kind") == "rule", F.struct("position", (F.col("allow") | (F.col("value") == "")).alias("allow"), F.col("value").alias("path")))
    out = grouped.groupBy("host", "group_no").agg(F.collect_set(F.when(F.col("kind") == "agent", F.lower("value"))).alias("agents"), F.array_sort(F.collect_list(rule)).alias("rules"), F.bool_or(F.col("kind").isin("rule", "pace")).alias("_said"))
    return out.where(F.col("_said") & (F.size("agents") > 0)).drop("_said")


def judge_robots(pages: DataFrame, robots: DataFrame, agent: str = "*", host: str = "host", url: str = "url") -> DataFrame:
    """Adds `allowed` to (host, url): whether the host's rules let an agent fetch it; a host without rules forbids nothing.

    The first group that names a part of the agent's name counts, else the first for all agents; of its rules the first
    whose path the URL's begins with, else it is allowed. A host has one row of rules, which meets its pages by a join."""
    own = agent.split("/")[0].lower()
    everybody = F.array_contains("agents", "*")
    rank = F.when(everybody, 1).when(F.exists("agents", lambda a: F.contains(F.lit(own), a)), 0)
    first = robots_rules(robots).withColumn("rank", rank).where("rank is not null").groupBy(F.col("host").alias("_h")).agg(F.min(F.struct("rank", "group_no", "rules"))["rules"].alias("_r"))
    rest = F.regexp_replace(urls.percent_decode(F.col(url)), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*|^//[^/?#]*", "")
    met = pages.join(first, F.col(host).eqNullSafe(F.col("_h")), "left").withColumn("_p", F.when(rest == "", "/").otherwise(rest))
    fits = F.filter("_r", lambda r: F.startswith(F.col("_p"), r["path"]))
    return met.withColumn("allowed", F.coalesce(F.get(fits, 0)["allow"], F.lit(True))).drop("_h", "_r", "_p")
