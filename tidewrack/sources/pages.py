"""HTML pages of a crawl: signals of each page, and the crawl's counters."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.functions import urls
from tidewrack.functions.numbers import percent

THIN_WORDS = 300
FRAMES = ("nav", "header", "footer", "aside")
LINK = pa.struct([("href", pa.string()), ("contextual", pa.bool_())])
ALTERNATE = pa.struct([("lang", pa.string()), ("href", pa.string())])
SIGNALS = {
    "title": pa.string(), "h1": pa.string(), "canonical": pa.string(), "robots": pa.string(), "hreflang": pa.list_(ALTERNATE), "og": pa.map_(pa.string(), pa.string()),
    "links": pa.list_(LINK), "words": pa.int32(), "json_ld": pa.list_(pa.string()), "json_ld_errors": pa.list_(pa.string()), "types": pa.list_(pa.string()),
}
SCHEMA = (
    "title string, h1 string, canonical string, robots string, hreflang array<struct<lang: string, href: string>>, og map<string, string>, "
    "links array<struct<href: string, contextual: boolean>>, words int, json_ld array<string>, json_ld_errors array<string>, types array<string>"
)


def token(value: str | None) -> str:
    return " ".join((value or "").lower().split())


def given(value: str | None) -> str | None:
    """An attribute's value without blanks around it; null for none."""
    return value.strip() or None if value else None


class Signals(HTMLParser):
    """First title, h1, canonical and Open Graph values, last robots rule, all alternates (a missing href is null), links, words and JSON-LD blocks."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title = self.h1 = self.canonical = self.robots = None
        self.hreflang, self.links, self.blocks = [], [], []
        self.og: dict[str, str] = {}
        self.words = self.frames = 0
        self.into: str | None = None
        self.held: list[str] = []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag in FRAMES:
            self.frames += 1
        elif tag == "title" and self.title is None or tag == "h1" and self.h1 is None:
            self.into, self.held = tag, []
        elif tag in ("script", "style"):
            self.into, self.held = "json" if tag == "script" and token(a.get("type")) == "application/ld+json" else "skip", []
        elif tag == "a" and a.get("href"):
            self.links.append({"href": a["href"], "contextual": self.frames == 0})
        elif tag == "link":
            rel = token(a.get("rel")).split()
            if "canonical" in rel and self.canonical is None:
                self.canonical = given(a.get("href"))
            if "alternate" in rel and a.get("hreflang"):
                self.hreflang.append({"lang": token(a["hreflang"]), "href": given(a.get("href"))})
        elif tag == "meta":
            if token(a.get("name")) == "robots":
                self.robots = token(a.get("content"))
            for name in ("property", "name"):  # some sites write the second in place of the first
                if key := token(a.get(name)):
                    if key.startswith("og:") and given(a.get("content")):
                        self.og.setdefault(key, given(a["content"]))
                    break

    def handle_endtag(self, tag):
        if tag in FRAMES:
            self.frames = max(0, self.frames - 1)
        elif self.into and tag == {"json": "script", "skip": tag if tag in ("script", "style") else None}.get(self.into, self.into):
            text = "".join(self.held)
            if self.into == "title":
                self.title = " ".join(text.split())
            elif self.into == "h1":
                self.h1 = " ".join(text.split())
            elif self.into == "json":
                self.blocks.append(text)
            self.into = None

    def handle_data(self, data):
        if self.into:
            self.held.append(data)
        else:
            self.words += len(data.split())


def entity_types(block) -> list[str]:
    """The @type values of a JSON-LD block, those of its @graph included."""
    out = []
    for item in block if isinstance(block, list) else [block]:
        if isinstance(item, dict):
            kind = item.get("@type")
            out += kind if isinstance(kind, list) else [kind] if kind else []
            if "@graph" in item:
                out += entity_types(item["@graph"])
    return [str(x) for x in out]


#: An ampersand that begins no "&amp;", outside of comments, scripts and styles.
LOOSE = re.compile(r"(<!--.*?-->|<(script|style)\b.*?</\2\s*>)|&(?!amp;)", re.DOTALL | re.IGNORECASE)


def signals(html: str, amp_only: bool = False) -> dict:
    p = Signals()
    p.feed(LOOSE.sub(lambda m: m[1] or "&amp;", html) if amp_only else html)
    p.close()
    good, bad, types = [], [], []
    for block in p.blocks:
        try:
            types += entity_types(json.loads(block))
            good.append(block)
        except ValueError as e:
            bad.append(str(e)[:200])
    return {"title": p.title, "h1": p.h1, "canonical": p.canonical, "robots": p.robots, "hreflang": p.hreflang, "og": list(p.og.items()), "links": p.links, "words": p.words, "json_ld": good, "json_ld_errors": bad, "types": types}


def extract(df: DataFrame, key: str, html: str = "html", amp_only: bool = False) -> DataFrame:
    """(key, signals...) for each page. Character references are read as browsers do, also without their semicolon; with
    amp_only all but "&amp;" stay as they are written."""
    kind = dict(df.dtypes)[key]

    def run(batches):
        for batch in batches:
            rows = [signals(x.as_py() or "", amp_only) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[n] for r in rows], t) for n, t in SIGNALS.items())], [key, *SIGNALS])

    return df.select(key, F.col(html).cast("string")).mapInArrow(run, f"`{key}` {kind}, {SCHEMA}")


#: Elements that text belongs to, those without an end, and those whose text is not shown.
BLOCKS = frozenset("html body main article section nav aside header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th blockquote pre figure figcaption form fieldset address details summary".split())
ENDLESS = frozenset("area base br col embed hr img input link meta source track wbr".split())
UNSEEN = frozenset("head script style noscript template".split())


class Blocks(HTMLParser):
    """(path, text) of the block elements of a page, in order; inline elements belong to the block around them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.unseen: list[str] = []
        self.held: list[str] = []
        self.found: list[tuple[str, str]] = []

    def flush(self):
        text = " ".join("".join(self.held).split())
        self.held.clear()
        if text:
            self.found.append(("/".join(self.open), text))

    def handle_starttag(self, tag, attrs):
        if self.unseen == ["head"] and tag in BLOCKS:
            self.unseen.clear()  # the end of a head may be left out
        if tag in UNSEEN:
            self.unseen.append(tag)
        if self.unseen or tag in ENDLESS:
            self.held.append(" " if tag == "br" and not self.unseen else "")
            return
        if tag in BLOCKS:
            self.flush()
            if self.open and self.open[-1] == "p" or tag == "li" and self.open and self.open[-1] == "li":
                self.open.pop()  # their ends may be left out too
            if tag not in ("html", "body") or tag not in self.open:
                self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in self.unseen:
            del self.unseen[self.unseen.index(tag) :]
        elif not self.unseen and tag in self.open:
            self.flush()
            while self.open.pop() != tag:
                pass

    def handle_data(self, data):
        if not self.unseen:
            self.held.append(data)


def blocks(df: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, position, path, text): the blocks of each page, in order."""
    kind = dict(df.dtypes)[key]

    def run(batches):
        for batch in batches:
            at, rows = [], []
            for i, page in enumerate(batch.column(1)):
                p = Blocks()
                p.feed(page.as_py() or "")
                p.close()
                p.flush()
                at += [i] * len(p.found)
                rows += [(n, *x) for n, x in enumerate(p.found)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.string(), pa.string())))], [key, "position", "path", "text"])

    return df.select(key, F.col(html).cast("string")).mapInArrow(run, f"`{key}` {kind}, position int, path string, text string")


def indexable(status: Column, robots: Column, canonical: Column, url: Column) -> Column:
    """True, false, or null where the page did not answer 200: it was not measured."""
    own = canonical.isNull() | (urls.normalise(urls.resolve(url, canonical)) == urls.normalise(url))
    return F.when(status == 200, ~F.contains(F.coalesce(robots, F.lit("")), F.lit("noindex")) & own)


def edges(extracted: DataFrame, url: str) -> DataFrame:
    """(src, dst, contextual, position): links to the same host, in normal form; repeated links stay."""
    rows = extracted.select(F.col(url).alias("src"), F.posexplode("links").alias("position", "link"))
    dst = urls.normalise(urls.resolve(F.col("src"), F.col("link.href")))
    return rows.select("src", dst.alias("dst"), F.col("link.contextual").alias("contextual"), "position").where(urls.host(F.col("src")) == urls.host(F.col("dst")))


def duplicate_titles(df: DataFrame, title: str = "title") -> DataFrame:
    """(duplicates, titles): pages beyond the first of each repeated title, and how many titles repeat; no title is no duplicate."""
    repeated = df.where(F.coalesce(title, F.lit("")) != "").groupBy(title).agg(F.count("*").alias("n")).where("n > 1")
    return repeated.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"), F.count("*").alias("titles"))


def thin(df: DataFrame, words: str = "words") -> DataFrame:
    return df.agg(F.count_if((F.col(words) > 0) & (F.col(words) < THIN_WORDS)).alias("thin"), F.count("*").alias("pages"))


def inventory_gap(declared: DataFrame, reached: DataFrame) -> DataFrame:
    """(declared, missing, gap_percent): declared nodes that were not reached; 0 percent of nothing."""
    seen = reached.select("node").distinct().withColumn("_r", F.lit(1))
    out = declared.select("node").distinct().join(seen, "node", "left").agg(F.count("*").alias("declared"), F.count_if(F.col("_r").isNull()).alias("missing"))
    return out.withColumn("gap_percent", percent(F.col("missing"), F.col("declared")))


def type_distribution(extracted: DataFrame) -> DataFrame:
    """JSON-LD types, the most frequent first, then by name."""
    return extracted.select(F.explode("types").alias("type")).groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")


def summary(pages: DataFrame) -> DataFrame:
    """Counters of a crawl, in one row. pages: extracted signals with url, status, depth, kilobytes, indexable, in_sitemap."""
    n = F.count_if
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return pages.agg(
        F.count("*").alias("pages"), n(F.col("status") >= 400).alias("errors"), n(F.col("status") == 0).alias("unreachable"), n(F.col("status") == 200).alias("ok"),
        n(F.col("indexable")).alias("indexable"), n(~F.col("indexable")).alias("not_indexable"), n(F.col("indexable").isNull()).alias("indexable_not_measured"),
        n(~has("title")).alias("without_title"), n(~has("h1")).alias("without_h1"), n(has("canonical")).alias("with_canonical"), n(F.size("hreflang") > 0).alias("with_hreflang"),
        n(F.size("og") > 0).alias("with_open_graph"), n(F.size("json_ld") > 0).alias("with_json_ld"), F.sum(F.size("json_ld_errors")).alias("json_ld_errors"),
        n((F.col("words") > 0) & (F.col("words") < THIN_WORDS)).alias("thin"), F.max(F.coalesce("depth", F.lit(0))).alias("max_depth"), n(F.col("depth").isNull()).alias("without_depth"),
        n(F.col("in_sitemap")).alias("in_sitemap"), F.bround(F.avg("kilobytes"), 1).alias("mean_kilobytes"),
    )
