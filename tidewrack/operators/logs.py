"""Access logs: which automated agents come, how often, and how often they are turned away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewrack.functions.numbers import half_even

#: Named agents in the order in which they are tried, their makers, categories and patterns.
AGENTS = (
    ("GPTBot", "OpenAI", "entrainement", "GPTBot"),
    ("OAI-SearchBot", "OpenAI", "recherche", "OAI-SearchBot"),
    ("ChatGPT-User", "OpenAI", "utilisateur", "ChatGPT-User"),
    ("ClaudeBot", "Anthropic", "entrainement", "ClaudeBot"),
    ("Claude-SearchBot", "Anthropic", "recherche", "Claude-SearchBot"),
    ("Claude-User", "Anthropic", "utilisateur", "Claude-User"),
    ("PerplexityBot", "Perplexity", "recherche", "PerplexityBot"),
    ("Perplexity-User", "Perplexity", "utilisateur", "Perplexity-User"),
    ("Google-Extended", "Google", "entrainement", "Google-Extended"),
    ("Applebot-Extended", "Apple", "entrainement", "Applebot-Extended"),
    ("Bytespider", "ByteDance", "entrainement", "Bytespider"),
    ("CCBot", "Common Crawl", "entrainement", "CCBot"),
    ("Amazonbot", "Amazon", "recherche", "Amazonbot"),
    ("meta-externalagent", "Meta", "entrainement", "meta-externalagent"),
    ("Diffbot", "Diffbot", "tiers", "Diffbot"),
)
#: A share of failed hits above this says that an agent may be blocked.
BLOCK_RATE = 0.5
TOP_PATHS = 10


def agent_catalogue(spark: SparkSession, agents=AGENTS) -> DataFrame:
    rows = [(i, *a) for i, a in enumerate(agents)]
    return spark.createDataFrame(rows, "rank int, agent string, maker string, category string, pattern string")


def first_agent(user_agent: Column, agents=AGENTS, field: int = 0) -> Column:
    """The first agent whose pattern the user agent contains, in any case; null if none does.

    The catalogue is small and ordered, so it becomes one CASE instead of a join by containment."""
    low, out = F.lower(user_agent), None
    for a in agents:
        hit = F.contains(low, F.lit(a[3].lower()))
        out = F.when(hit, a[field]) if out is None else out.when(hit, a[field])
    return out if out is not None else F.lit(None).cast("string")


def first_match(hits: DataFrame, text: str, catalogue: DataFrame, key: list[str]) -> DataFrame:
    """The same by join, for catalogues that are tables: the row of least rank whose pattern the text contains.

    hits are reduced to distinct texts first, so the containment join grows with texts and not with hits."""
    texts = hits.select(text).distinct()
    met = texts.join(catalogue, F.contains(F.lower(text), F.lower("pattern")))
    first = met.groupBy(text).agg(F.min(F.struct("rank", *key)).alias("m")).select(text, *[F.col(f"m.{k}").alias(k) for k in key])
    return hits.join(first, text, "left")


def breakdown(hits: DataFrame, agent: str = "agent", status: str = "status") -> DataFrame:
    """Hits, failed hits and failure rate of each agent; an agent is suspect if its rounded rate is above BLOCK_RATE.

    A hit fails if its status is neither 2xx nor 3xx. Rows without an agent are left out."""
    failed = ~F.col(status).between(200, 399)
    out = hits.where(F.col(agent).isNotNull()).groupBy(agent).agg(F.count("*").alias("hits"), F.count_if(failed).alias("failed"))
    return out.withColumn("failure_rate", half_even(F.col("failed") / F.col("hits"), 3)).withColumn("suspect", F.col("failure_rate") > BLOCK_RATE)


def category_rollup(hits: DataFrame, category: str = "category", agent: str = "agent") -> DataFrame:
    """Hits by category and agent, by category, and in all; level tells the three apart."""
    return hits.rollup(category, agent).agg(F.count("*").alias("hits"), F.grouping_id().alias("level"))


def top_paths(hits: DataFrame, agent: str, path: str, order: str, n: int = TOP_PATHS) -> DataFrame:
    """The n most hit paths of each agent; of equals, the one seen first."""
    counts = hits.groupBy(agent, path).agg(F.count("*").alias("hits"), F.min(order).alias("first_seen"))
    w = Window.partitionBy(agent).orderBy(F.desc("hits"), "first_seen", path)
    return counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def status_map(hits: DataFrame, agent: str = "agent", status: str = "status") -> DataFrame:
    """Each agent's hits by status, as a map."""
    counts = hits.groupBy(agent, status).agg(F.count("*").alias("n"))
    return counts.groupBy(agent).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(status).cast("string"), "n")))).alias("statuses"))


def not_measurable(spark: SparkSession, source: str, missing: str, remedy: str) -> DataFrame:
    """One row that says what was not measured and what would help: counters are null, never 0."""
    return spark.createDataFrame([(source, "non-mesurable", None, None, None, missing, remedy)], "source string, verdict string, read long, recognised long, ignored long, missing string, remedy string")


def unmeasured(sources: DataFrame, measured: DataFrame, missing: str, remedy: str) -> DataFrame:
    """not_measurable rows, one for each (source) that has no (source) row among the measured ones."""
    left = sources.select("source").distinct().join(measured.select("source"), "source", "left_anti")
    none = F.lit(None).cast("long")
    return left.select("source", F.lit("non-mesurable").alias("verdict"), none.alias("read"), none.alias("recognised"), none.alias("ignored"), F.lit(missing).alias("missing"), F.lit(remedy).alias("remedy"))


def latest_measured(runs: DataFrame, key: list[str], date: str = "date", measured: str = "measured") -> DataFrame:
    """The latest measured row of each key, or the latest row where nothing was ever measured."""
    w = Window.partitionBy(*key).orderBy(F.col(measured).desc(), F.col(date).desc())
    return runs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
