"""What a site's template repeats on its pages, and what is left of a page without it.

A block is the text of one element with the path of tags that leads to it. Blocks that stand at the same path with the
same text on many pages of a host are its template. They are counted and joined by hashes; a host with a third of all
pages is counted in parts first, and the join's left side, the blocks, is the one that adaptive execution can split.

Pages whose own text is nearly the same are found by MinHash sketches: SIZE least hashes of the word shingles, in BANDS
bands; in each bucket of a band the least page heads the others, so a bucket of any size gives one candidate a page. Candidates are verified
by their whole shingle sets; a sketch can miss a pair and never makes one up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE, BANDS = 64, 16
UNIQUE_LEAST = 0.4


def _identity(text: str = "text") -> list[Column]:
    return [F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b")]


def template_blocks(blocks: DataFrame, least_pages: int = 2, share: float = 0.2) -> DataFrame:
    """(host, path, a, b, text, pages): blocks on `least_pages` pages of their host, and on `share` of its pages, or more.

    blocks: (host, page, path, text)."""
    rows = blocks.select("host", "page", "path", "text", *_identity())
    once = rows.groupBy("host", "path", "a", "b", "page").agg(F.min("text").alias("text"))
    counted = once.groupBy("host", "path", "a", "b").agg(F.count("*").alias("pages"), F.min("text").alias("text"))
    sizes = blocks.select("host", "page").distinct().groupBy(F.col("host").alias("of")).agg(F.count("*").alias("all"))
    met = counted.where(F.col("pages") >= least_pages).join(sizes, F.col("host").eqNullSafe(F.col("of")))
    return met.where(F.col("pages") >= share * F.col("all")).select("host", "path", "a", "b", "text", "pages")


def own_blocks(blocks: DataFrame, template: DataFrame) -> DataFrame:
    """(host, page, position, path, text, own): own is false for what the template holds."""
    known = template.select(F.col("host").alias("h"), F.col("path").alias("p"), "a", "b", F.lit(True).alias("held"))
    rows = blocks.select("host", "page", "position", "path", "text", *[c.alias(n) for c, n in zip(_identity(), ("x", "y"), strict=True)])
    met = rows.join(known, F.col("host").eqNullSafe(F.col("h")) & (F.col("path") == F.col("p")) & (F.col("x") == F.col("a")) & (F.col("y") == F.col("b")), "left")
    return met.select("host", "page", "position", "path", "text", F.col("held").isNull().alias("own"))


def own_share(own: DataFrame, least: float = UNIQUE_LEAST) -> DataFrame:
    """(page, words, own_words, value, ok) of each page with any word: the share of its words outside the template."""
    n = F.regexp_count("text", F.lit(r"\S+"))
    out = own.groupBy("page").agg(F.sum(n).cast("long").alias("words"), F.coalesce(F.sum(F.when(F.col("own"), n)), F.lit(0)).cast("long").alias("own_words"))
    return out.where("words > 0").withColumn("value", F.col("own_words") / F.col("words")).withColumn("ok", F.col("value") >= least)


def own_text(own: DataFrame) -> DataFrame:
    """(page, text): a page's own blocks in their order, one on a line."""
    parts = F.array_sort(F.collect_list(F.struct("position", "text")))
    return own.where("own").groupBy("page").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("text"))


def shingles(pages: DataFrame, k: int = 5) -> DataFrame:
    """(page, s): hashes of the distinct k-word shingles of (page, text); a page of fewer words has the one that they make."""
    words = pages.select("page", F.regexp_extract_all(F.lower("text"), F.lit(r"\S+"), 0).alias("w")).where(F.size("w") > 0)
    grams = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - k, F.lit(0))), lambda i: F.xxhash64(F.array_join(F.slice("w", i + 1, k), " ")))
    return words.select("page", F.explode(F.array_distinct(grams)).alias("s"))


def sketches(grams: DataFrame, size: int = SIZE) -> DataFrame:
    """(page, sketch, n): the least of each of `size` hashes over a page's shingles, and how many these are."""
    least = [F.min(F.xxhash64(F.lit(i), "s")) for i in range(size)]
    return grams.groupBy("page").agg(F.array(*least).alias("sketch"), F.count("*").alias("n"))


def near_pages(grams: DataFrame, threshold: float = 0.8, size: int = SIZE, bands: int = BANDS) -> DataFrame:
    """(page, like, similarity): smaller pages whose sets of shingles (page, s) have a Jaccard similarity of the threshold or more.

    A page is held against the least page of each of its buckets, `bands` pages at most."""
    width = size // bands
    bucket = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.struct(i.alias("band"), F.xxhash64(F.slice("sketch", i * width + 1, width)).alias("key")))
    rows = sketches(grams, size).select("page", F.explode(bucket).alias("at")).select("page", "at.*")
    heads = rows.groupBy(F.col("band").alias("of"), F.col("key").alias("same")).agg(F.min("page").alias("like"))
    pairs = rows.join(heads, (F.col("band") == F.col("of")) & (F.col("key") == F.col("same"))).where("page <> like").select("page", "like").distinct()
    sizes = grams.groupBy(F.col("page").alias("of")).agg(F.count("*").alias("n"))
    mine = pairs.join(grams, "page")
    theirs = grams.select(F.col("page").alias("other"), F.col("s").alias("t"))
    both = mine.join(theirs, (F.col("like") == F.col("other")) & (F.col("s") == F.col("t"))).groupBy("page", "like").agg(F.count("*").alias("both"))
    a, b = sizes.select(F.col("of").alias("page"), F.col("n").alias("n1")), sizes.select(F.col("of").alias("like"), F.col("n").alias("n2"))
    met = both.join(a, "page").join(b, "like").withColumn("similarity", F.col("both") / (F.col("n1") + F.col("n2") - F.col("both")))
    return met.where(F.col("similarity") >= threshold).select("page", "like", "similarity")
