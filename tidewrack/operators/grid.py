"""Metrics that the audit method describes in words. Each gives a value and whether its criterion holds.

These follow the method's text; no earlier program computes them. A metric without rows is null and not met by
default: nothing was measured."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.functions.numbers import ratio
from tidewrack.operators.table import quantile, tiles


def _verdict(df: DataFrame, value: Column, ok: Column) -> DataFrame:
    return df.agg(value.alias("value")).withColumn("ok", ok)


def theme_concentration(pages: DataFrame, theme: str, top: int = 3, least: float = 0.7) -> DataFrame:
    """Share of pages in the `top` largest themes."""
    counts = pages.groupBy(theme).agg(F.count("*").alias("n"))
    first = counts.orderBy(F.desc("n"), theme).limit(top).agg(F.sum("n").alias("first"))
    both = counts.agg(F.sum("n").alias("all")).join(F.broadcast(first))  # one row each
    return _verdict(both, ratio(F.sum("first"), F.sum("all")), F.col("value") >= least)


def share_meeting(rows: DataFrame, condition: Column, least: float | None = None, most: float | None = None) -> DataFrame:
    """Share of rows that meet a condition: format mismatches, answered questions, indexed pages, close mentions and the like."""
    ok = F.lit(True)
    if least is not None:
        ok = ok & (F.col("value") >= least)
    if most is not None:
        ok = ok & (F.col("value") <= most)
    return _verdict(rows, ratio(F.count_if(condition), F.count("*")), ok)


def enough(rows: DataFrame, least: int, distinct: str | None = None) -> DataFrame:
    """Whether there are `least` rows, or distinct values."""
    return _verdict(rows, F.count_distinct(distinct) if distinct else F.count("*"), F.col("value") >= least)


def groups_with(rows: DataFrame, group: str, least: int) -> DataFrame:
    """Groups that have `least` rows: attackable queries, recurring themes."""
    return rows.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def hidden_queries(queries: DataFrame, suggested: DataFrame, covered: DataFrame, key: str = "query") -> DataFrame:
    """Queries outside the first ten places that people also ask and that no page covers."""
    return queries.where(F.col("position") > 10).join(suggested.select(key), key, "left_semi").join(covered.select(key), key, "left_anti")


def one_page_each(pages: DataFrame, query: str, depth: str, deepest: int = 2) -> DataFrame:
    """Money queries with more or fewer pages than one, or with a page that lies too deep."""
    per = pages.groupBy(query).agg(F.count("*").alias("n"), F.max(depth).alias("depth"))
    return per.where((F.col("n") != 1) | F.col("depth").isNull() | (F.col("depth") > deepest))


def money_pages_in_top_decile(pages: DataFrame, links: str, money: str) -> DataFrame:
    """Share of money pages in the first of ten equal parts of the pages, those that most links name."""
    ranked = tiles(pages, [F.desc(links), *[F.col(c) for c in pages.columns if c not in (links, money)]], "_tile")
    return share_meeting(ranked.where(F.col(money)), F.col("_tile") == 1, least=1.0)


def money_depth(pages: DataFrame, depth: str, money: str) -> DataFrame:
    """No money page deeper than three clicks, and nine pages in ten within four."""
    out = pages.agg(F.count_if(F.col(money) & (F.col(depth) > 3)).alias("deep_money_pages"), ratio(F.count_if(F.col(depth) <= 4), F.count(depth)).alias("value"))
    return out.withColumn("ok", (F.col("deep_money_pages") == 0) & (F.col("value") >= 0.9))


def few_inbound(pages: DataFrame, contextual: str, least: int = 3) -> DataFrame:
    return pages.where(F.coalesce(contextual, F.lit(0)) < least)


def long_tail(queries: DataFrame, clicks: str, below: int = 10) -> DataFrame:
    """Share of clicks from rarely clicked queries: healthy from 40 percent, dependent under 15."""
    small = F.when(F.col(clicks) < below, F.col(clicks)).otherwise(0)
    out = queries.agg(ratio(F.sum(small), F.sum(clicks)).alias("value"))
    return out.withColumn("state", F.when(F.col("value") >= 0.4, "healthy").when(F.col("value") < 0.15, "dependent").when(F.col("value").isNotNull(), "between"))


def rate_gaps(queries: DataFrame, band: str, rate: str, gap: float = 0.3) -> DataFrame:
    """Rows whose click rate is more than `gap` below the median of their position band."""
    medians = quantile(queries, [band], rate, 0.5, "median")
    return queries.join(medians, band).where(F.col(rate) < (1 - gap) * F.col("median"))


def expected_gain(queries: DataFrame, impressions: str, rate: str, expected: str, n: int = 10) -> DataFrame:
    """The n rows with most clicks to win, among positions 11 to 30."""
    return queries.where(F.col("position").between(11, 30)).withColumn("gain", F.col(impressions) * (F.col(expected) - F.col(rate))).orderBy(F.desc("gain"), "query").limit(n)


def unique_content(pages: DataFrame, page: str, words: str, least: float = 0.4, shingle: int = 5) -> DataFrame:
    """Share of each page's word shingles that no other page has."""
    grams = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - shingle, F.lit(0))), lambda i: F.array_join(F.slice(words, i + 1, shingle), " "))
    rows = pages.where(F.size(words) > 0).select(page, F.explode(F.array_distinct(grams)).alias("g"))
    alone = rows.groupBy("g").agg(F.count("*").alias("n"))
    met = rows.join(alone, "g").groupBy(page).agg((F.count_if(F.col("n") == 1) / F.count("*")).alias("value"))
    return met.withColumn("ok", F.col("value") >= least)


def chain_faults(pages: DataFrame, chain: str, most: int = 2) -> DataFrame:
    """Pages whose redirect chain is too long or comes back to itself."""
    loop = F.size(F.array_distinct(chain)) < F.size(chain)
    return pages.withColumn("loop", loop).where((F.size(chain) > most) | loop)


def index_delay(pages: DataFrame, published: str, indexed: str, most: int = 7) -> DataFrame:
    """Median days from publication to index."""
    days = pages.where(F.col(indexed).isNotNull()).select(F.datediff(F.col(indexed), F.col(published)).alias("days"))
    return _verdict(quantile(days, [], "days", 0.5, "days"), F.max("days"), F.col("value") <= most)


def stale_dates(pages: DataFrame, modified: str, most: float = 0.5) -> DataFrame:
    """Share of pages that carry the most frequent modification date: a mass update says nothing of any page."""
    counts = pages.groupBy(modified).agg(F.count("*").alias("n"))
    return _verdict(counts, ratio(F.max("n"), F.sum("n")), F.col("value") <= most)


def referrer_share(hits: DataFrame, domain: str, named: list[str]) -> DataFrame:
    """Hits of each referrer, and whether it is one of the named domains."""
    counts = hits.groupBy(domain).agg(F.count("*").alias("n"))
    whole = F.broadcast(counts.agg(F.sum("n").alias("_all")))  # one row
    return counts.join(whole).withColumn("named", F.col(domain).isin(*named)).withColumn("share", F.col("n") / F.col("_all")).drop("_all")


def engagement_gap(pages: DataFrame, group: str, value: str) -> DataFrame:
    """Each group's median against the site's."""
    site = quantile(pages, [], value, 0.5, "site_median")
    return quantile(pages, [group], value, 0.5, "median").join(site).withColumn("above", F.col("median") > F.col("site_median"))


def reply_rate(reviews: DataFrame, replied: str, least: float = 0.5) -> DataFrame:
    return share_meeting(reviews, F.col(replied), least=least)


def divergent(listings: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Places whose name, address or telephone differ between directories, blanks and case aside."""
    plain = [F.count_distinct(F.lower(F.regexp_replace(F.col(f), r"[\s.()-]+", ""))).alias(f) for f in fields]
    return listings.groupBy(key).agg(*plain).where(" or ".join(f"`{f}` > 1" for f in fields))


def citation_rate(runs: DataFrame, question: str, cited: str) -> DataFrame:
    """Rate of citation with its spread over runs; a rate of one run has none and is no plan."""
    per = runs.groupBy(question).agg(F.avg(F.col(cited).cast("double")).alias("rate"), F.count("*").alias("runs"))
    return per.agg(F.avg("rate").alias("rate"), F.min("rate").alias("lowest"), F.max("rate").alias("highest"), F.stddev("rate").alias("spread"), F.min("runs").alias("fewest_runs"))


def useless_pages(pages: DataFrame, clicked: DataFrame, linked: DataFrame, converting: DataFrame, key: str = "url") -> DataFrame:
    """Pages without a click, a link in or a conversion."""
    for other in (clicked, linked, converting):
        pages = pages.join(other.select(key).distinct(), key, "left_anti")
    return pages


def answer_length(texts: DataFrame, text: str, most: int = 60) -> DataFrame:
    """Words of the paragraph that follows a question heading, and whether it is short enough to be quoted."""
    answer = F.regexp_extract(text, r"(?m)^#+[^\n]*\?\s*\n+([^\n]+)", 1)
    words = F.regexp_count(answer, F.lit(r"\S+"))
    return texts.withColumn("answer_words", F.when(answer != "", words)).withColumn("ok", F.col("answer_words") <= most)


def floor_check(rows: DataFrame, group: str, value: str, floor: float) -> DataFrame:
    """Each group's total against a floor that the study sets itself; without one value the group is not measured (null)."""
    return rows.groupBy(group).agg(F.sum(value).alias("total")).withColumn("ok", F.col("total") >= floor)


def conversion_delay(events: DataFrame, start: str, end: str) -> DataFrame:
    """Median days from publication to conversion, over what converted."""
    days = events.where(F.col(end).isNotNull()).select(F.datediff(F.col(end), F.col(start)).alias("days"))
    return quantile(days, [], "days", 0.5, "median_days")


def uncovered(money: DataFrame, pages: DataFrame, key: str = "query") -> DataFrame:
    """Money queries that no page covers; the criterion is that there are none."""
    return money.join(pages.select(key), key, "left_anti")


def locale_coverage(terms: DataFrame, locale: str, source: str, level: str, sources: int = 2, levels: int = 4) -> DataFrame:
    """Lexical fit of each locale: enough sources and all levels of language."""
    out = terms.groupBy(locale).agg(F.count_distinct(source).alias("sources"), F.count_distinct(level).alias("levels"))
    return out.withColumn("ok", (F.col("sources") >= sources) & (F.col("levels") >= levels))


def empty_stages(pages: DataFrame, stage: str, stages: list[str]) -> DataFrame:
    """Stages of the journey that no page serves, from the fixed list of stages."""
    fixed = pages.sparkSession.createDataFrame([(s,) for s in stages], f"{stage} string")
    return fixed.join(pages.select(stage), stage, "left_anti")


def criteria_met(rows: DataFrame, flags: list[str], least: int = 4) -> DataFrame:
    """Adds met, how many criteria hold, and ok; a criterion that was not judged does not hold."""
    met = reduce(Column.__add__, [F.coalesce(F.col(f), F.lit(False)).cast("int") for f in flags])
    return rows.withColumn("met", met).withColumn("ok", F.col("met") >= least)


def index_status(pages: DataFrame, reason: str, indexed: str, depth: str, deep: int = 4, least: float = 0.8) -> DataFrame:
    """(indexed, pages, value, deep_value, reasons, ok): share of pages in the index, of all and of deep ones, and how many reasons keep others out."""
    far = F.col(depth) >= deep
    out = pages.agg(
        F.count_if(F.col(indexed)).alias("indexed"), F.count("*").alias("pages"), ratio(F.count_if(F.col(indexed)), F.count("*")).alias("value"),
        ratio(F.count_if(F.col(indexed) & far), F.count_if(far)).alias("deep_value"), F.count_distinct(F.when(~F.col(indexed), F.col(reason))).alias("reasons"),
    )
    return out.withColumn("ok", (F.col("value") >= least) & F.coalesce(F.col("deep_value") >= least, F.lit(True)))


def entity_links(entities: DataFrame, entity: str, same_as: str, least: int = 3) -> DataFrame:
    """Entities with how many distinct profiles they name, and whether these are enough."""
    return entities.withColumn("profiles", F.size(F.array_distinct(same_as))).withColumn("ok", F.col("profiles") >= least).select(entity, "profiles", "ok")


def brand_first(results: DataFrame, query: str, site: str, own: str) -> DataFrame:
    """Brand queries with the own site's best place, and whether it is the first."""
    return results.groupBy(query).agg(F.min(F.when(F.col(site) == own, F.col("position"))).alias("place")).withColumn("ok", F.coalesce(F.col("place") == 1, F.lit(False)))


def declared_capabilities(rows: DataFrame, key: str, names: list[str]) -> DataFrame:
    """(key, missing): which of the fixed capabilities a study does not declare."""
    held = rows.groupBy(key).agg(F.collect_set("capability").alias("held"))
    return held.select(key, F.array_sort(F.array_except(F.array(*map(F.lit, names)), "held")).alias("missing"))


def maturity(score: Column) -> Column:
    return F.when(score >= 0.9, 5).when(score >= 0.7, 4).when(score >= 0.5, 3).when(score >= 0.3, 2).when(score.isNotNull(), 1)


def crawler_hits(hits: DataFrame, pages: DataFrame) -> DataFrame:
    """(agent, template, depth, hits, pages_hit, wasted): where crawlers spend their visits; wasted are those of pages that are not indexable.

    hits: (agent, url); pages: (url, template, depth, indexable). Hits of pages that no crawl knows have no template."""
    counted = hits.groupBy("agent", "url").agg(F.count("*").alias("n"))  # a page may have a third of all hits
    met = counted.join(pages, "url", "left")
    out = met.groupBy("agent", "template", "depth").agg(F.sum("n").alias("hits"), F.count("*").alias("pages_hit"), F.coalesce(F.sum(F.when(~F.col("indexable"), F.col("n"))), F.lit(0)).alias("wasted"))
    return out.select("agent", "template", "depth", "hits", "pages_hit", "wasted")


def markup_by_template(pages: DataFrame, eligible: list[str]) -> DataFrame:
    """(template, pages, marked, errors, value, ok) of each eligible template: all of its pages carry valid structured data and none a broken block.

    pages: (template, blocks, errors), numbers of valid and broken blocks. A template without pages is not measured."""
    fixed = pages.sparkSession.createDataFrame([(t,) for t in eligible], "template string")
    found = pages.groupBy("template").agg(F.count("*").alias("pages"), F.count_if(F.col("blocks") > 0).alias("marked"), F.sum("errors").alias("errors"))
    out = fixed.join(found, "template", "left").withColumn("value", F.col("marked") / F.col("pages"))
    return out.select("template", F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("marked", F.lit(0)).alias("marked"), F.coalesce("errors", F.lit(0)).alias("errors"), "value", ((F.col("value") == 1) & (F.col("errors") == 0)).alias("ok"))


def sitemap_health(pages: DataFrame, least: float = 0.95) -> DataFrame:
    """(declared, not_200, noindex, canonical_away, not_seen, present, ok) of a sitemap: none of its URLs fails, is kept out of the
    index or names another page as its own, and nearly all pages of value are in it.

    pages: (url, status, noindex, away, in_sitemap, valued); a declared page that was not crawled has a null status and is named, not judged."""
    inside = F.coalesce(F.col("in_sitemap"), F.lit(False))
    n = lambda c: F.count_if(inside & F.coalesce(c, F.lit(False)))
    out = pages.agg(
        F.count_if(inside).alias("declared"), n(F.col("status") != 200).alias("not_200"), n(F.col("noindex")).alias("noindex"), n(F.col("away")).alias("canonical_away"),
        n(F.col("status").isNull()).alias("not_seen"), ratio(F.count_if(F.col("valued") & inside), F.count_if(F.col("valued"))).alias("present"),
    )
    clean = (F.col("not_200") == 0) & (F.col("noindex") == 0) & (F.col("canonical_away") == 0)
    return out.withColumn("ok", clean & (F.col("present") >= least))


#: Fixed value: an address in a directive file.
CITED = r"https?://[^\s<>()\[\]\"']+[^\s<>()\[\]\"'.,;:!?]"


def directive_urls(files: DataFrame, pages: DataFrame, declared: DataFrame) -> DataFrame:
    """(host, cited, answering, unseen, undeclared, ok) of each host's directive file: every URL that it cites answers, and is in the sitemap.

    files: (host, body); pages: (url, status); declared: (url). What was not crawled is counted apart and not judged."""
    cited = files.select("host", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(CITED), 0))).alias("url"))
    met = cited.join(pages.select("url", "status"), "url", "left").join(declared.select("url", F.lit(True).alias("listed")).distinct(), "url", "left")
    found = met.groupBy(F.col("host").alias("h")).agg(
        F.count("*").alias("cited"), F.count_if(F.col("status") == 200).alias("answering"), F.count_if(F.col("status").isNull()).alias("unseen"), F.count_if(F.col("listed").isNull()).alias("undeclared")
    )
    out = files.select("host").distinct().join(found, F.col("host") == F.col("h"), "left").drop("h").fillna(0, ["cited", "answering", "unseen", "undeclared"])
    return out.withColumn("ok", (F.col("answering") + F.col("unseen") == F.col("cited")) & (F.col("undeclared") == 0))


def minimum_counts(candidates: DataFrame, minimums: dict[int, int], qualities: list[str]) -> DataFrame:
    """(node, n, least, ok): how many distinct candidates of each judgement have all of the qualities, against its minimum.

    candidates: (node, name, qualities...)."""
    whole = reduce(Column.__and__, [F.coalesce(F.nullif(F.trim(F.col(q).cast("string")), F.lit("")).isNotNull(), F.lit(False)) for q in qualities])
    fixed = candidates.sparkSession.createDataFrame(list(minimums.items()), "node int, least int")
    found = candidates.where(whole).groupBy(F.col("node").alias("_n")).agg(F.count_distinct("name").alias("n"))
    out = fixed.join(found, F.col("node") == F.col("_n"), "left").select("node", F.coalesce("n", F.lit(0)).alias("n"), "least")
    return out.withColumn("ok", F.col("n") >= F.col("least"))


def unjustified(recommendations: DataFrame, reason: str, admitted: list[str]) -> DataFrame:
    """Recommendations whose reason is none of the admitted ones, or missing."""
    return recommendations.where(~F.coalesce(F.col(reason).isin(*admitted), F.lit(False)))


def lead_cost(channels: DataFrame, group: str, spent: str, leads: str) -> DataFrame:
    """(group, spent, leads, value): what a lead cost; null where either was not declared, or there was no lead."""
    out = channels.groupBy(group).agg(F.sum(spent).alias("spent"), F.sum(leads).alias("leads"))
    return out.withColumn("value", F.when(F.col("leads") > 0, F.col("spent") / F.col("leads")))


def customer_value(sales: DataFrame, group: str, customer: str, amount: str) -> DataFrame:
    """(group, customers, basket, recurrence, value): mean sale, sales a customer, and what a customer brings."""
    by_customer = sales.groupBy(group, customer).agg(F.count("*").alias("n"), F.sum(amount).alias("total"))
    out = by_customer.groupBy(group).agg(F.count("*").alias("customers"), F.sum("n").alias("sales"), F.sum("total").alias("total"))
    return out.select(group, "customers", (F.col("total") / F.col("sales")).alias("basket"), (F.col("sales") / F.col("customers")).alias("recurrence"), (F.col("total") / F.col("customers")).alias("value"))


def link_gap(links: DataFrame, own: str) -> DataFrame:
    """(domain, competitors): domains that link to competitors and not to the own site, and to how many of them. links: (site, domain)."""
    sites = links.select("site", "domain").distinct()
    mine = sites.where(F.col("site") == own).select("domain")
    return sites.where(F.col("site") != own).join(mine, "domain", "left_anti").groupBy("domain").agg(F.count("*").alias("competitors"))


def domains_against(links: DataFrame, own: str) -> DataFrame:
    """(own, competitors, median, best, ok): referring domains of the own site against those of its competitors; ok is not less than their median."""
    counts = links.groupBy("site").agg(F.count_distinct("domain").alias("n"))
    middle = quantile(counts.where(F.col("site") != own), [], "n", 0.5, "median")
    out = counts.agg(F.coalesce(F.max(F.when(F.col("site") == own, F.col("n"))), F.lit(0)).alias("own"), F.count_if(F.col("site") != own).alias("competitors"), F.max(F.when(F.col("site") != own, F.col("n"))).alias("best"))
    return out.join(F.broadcast(middle)).select("own", "competitors", "median", "best", (F.col("own") >= F.col("median")).alias("ok"))
