"""Result tables and window-shaped computations: search, sort, groups, spines, gaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.functions.numbers import first_number
from tidewrack.functions.text import fingerprint, fold_accents
from tidewrack.operators.graph import cut_lineage

#: Tables with fewer rows get no column filters.
FILTER_ROWS = 5
#: A range wider than this is joined by comparison instead of being spelt out.
WIDEST_RANGE = 10_000


def search(df: DataFrame, columns: list[str], wanted: str) -> DataFrame:
    """Rows whose visible text contains the words, whatever their case and accents."""
    seen = fold_accents(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]))
    return df.where(F.contains(seen, fold_accents(F.lit(wanted))))


def sort(df: DataFrame, by: str, numeric: bool, descending: bool, group: str | None = None, key: str | None = None) -> DataFrame:
    """Sorted by group, then by a column as number or text; rows without a value come last in either direction."""
    value = first_number(F.col(by).cast("string")) if numeric else fold_accents(F.nullif(F.col(by).cast("string"), F.lit("")))
    order = value.desc_nulls_last() if descending else value.asc_nulls_last()
    first = [first_number(F.col(group).cast("string")).asc_nulls_last(), F.col(group)] if group else []
    return df.orderBy(*first, order, *([key] if key else []))


#: Letters alike but for case and accents are the same, ligatures and sharp s are the letters they stand for.
ALIKE = "UNICODE_CI_AI"


def locale_search(df: DataFrame, columns: list[str], wanted: str, collation: str = ALIKE) -> DataFrame:
    """Rows whose visible text contains the words as a reader of any language takes them: by collation, not by a list of letters."""
    seen = F.concat_ws(" ", *[F.col(c).cast("string") for c in columns])
    return df.where(F.contains(F.collate(seen, collation), F.collate(F.lit(wanted), collation)))


def locale_sort(df: DataFrame, by: str, descending: bool = False, group: str | None = None, key: str | None = None, locale: str = "fr") -> DataFrame:
    """Sorted by group and column in the order of a language; in a group or column numbers come first, by their size; rows
    without a value come last in either direction."""

    def order(c: str, down: bool) -> list[Column]:
        text = F.nullif(F.col(c).cast("string"), F.lit(""))
        number, word = first_number(F.regexp_extract(text, r"^\s*([+-]?\d[\d\s.,]*)", 1)), F.collate(text, locale)
        return [text.isNull().asc(), number.desc_nulls_last() if down else number.asc_nulls_last(), word.desc_nulls_last() if down else word.asc_nulls_last()]

    first = order(group, False) if group else []
    return df.orderBy(*first, *order(by, descending), *([key] if key else []))


def locale_groups(df: DataFrame, column: str, collation: str = ALIKE) -> DataFrame:
    """(column, n, forms): values that are the same under a collation, under the least of them in code-point order, with how many
    rows and how many distinct values they are."""
    values = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    grouped = values.groupBy(F.collate(F.col(column), collation).alias("_g")).agg(F.min(F.col(column)).alias(column), F.sum("n").alias("n"), F.count("*").alias("forms"))
    return grouped.drop("_g")


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds the place of each row in a total order, from 1.

    Rows are sorted by range over all partitions and kept; a row's place is its place in its partition plus the
    rows of the partitions before it. Only one row for each partition meets in one task."""
    placed = cut_lineage(df.orderBy(*order).withColumn("_i", F.monotonically_increasing_id()))
    part = F.shiftright("_i", 33).alias("_p")
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = placed.groupBy(part).agg(F.count("*").alias("_n")).select(F.col("_p").alias("_q"), before.alias("_o"))
    place = F.col("_o") + F.col("_i").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.join(offsets, F.shiftright("_i", 33) == F.col("_q")).withColumn(name, place).drop("_i", "_q", "_o")


def tiles(df: DataFrame, order: list[Column], name: str, k: int = 10) -> DataFrame:
    """Adds the tile, 1 to k, of each row in a total order; the first tiles hold the rows that don't divide."""
    n = F.col("_t")
    q, r = F.floor(n / k), n % k
    wide = r * (q + 1)
    tile = F.when(F.col("_r") <= wide, F.ceil(F.col("_r") / (q + 1))).otherwise(r + F.ceil((F.col("_r") - wide) / F.greatest(q, F.lit(1))))
    ranked = global_rank(df, order, "_r")
    return ranked.join(F.broadcast(ranked.agg(F.count("*").alias("_t")))).withColumn(name, tile.cast("int")).drop("_r", "_t")


def quantile(df: DataFrame, keys: list[str], value: str, q: float, name: str) -> DataFrame:
    """(keys, name): each group's quantile of a value, between its two nearest values; null values are left out.

    Rows are ranked over all partitions, so a group with a third of all rows is not gathered in one task."""
    rows = global_rank(df.where(F.col(value).isNotNull()).select(*keys, value), [*map(F.col, keys), F.col(value)], "_r")
    ends = rows.groupBy(*keys).agg(F.min("_r").alias("_a"), F.count("*").alias("_n"))
    at = F.lit(q) * (F.col("_n") - 1)
    met = rows.join(ends.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)}), reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.lit(True)))
    place = F.col("_r") - F.col("_a")
    near = met.where((place >= F.floor(at)) & (place <= F.ceil(at)))
    low, high = F.min(value).cast("double"), F.max(value).cast("double")
    share = F.max(at - F.floor(at))
    return near.groupBy(*keys).agg((low + (high - low) * share).alias(name))


def uncounted(tables: DataFrame, filterable: str = "filterable", counted: str = "counted") -> DataFrame:
    """Adds `missing` and `ok`: every table that can be filtered has a counter; a counter without filters is no fault."""
    missing = F.array_sort(F.array_except(filterable, counted))
    return tables.withColumn("missing", missing).withColumn("ok", F.size("missing") == 0)


def group_fingerprint(df: DataFrame, group: str, key: str, content: str) -> DataFrame:
    """(group, n, fingerprint): each group's content in twelve digits. Rows add up the hash of their key and text, so their
    order does not matter and no group is gathered."""
    row = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(content), F.lit("")))
    number = F.conv(fingerprint(row), 16, 10).cast("decimal(38,0)")
    out = df.groupBy(group).agg(F.count("*").alias("n"), F.sum(number).cast("string").alias("_s"))
    return out.select(group, "n", fingerprint(F.concat(F.col("n").cast("string"), F.lit(":"), "_s")).alias("fingerprint"))


def by_count(df: DataFrame, value: str, n: int | None = None) -> DataFrame:
    """Values with their rows, the most frequent first, then by value."""
    out = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n"), value)
    return out if n is None else out.limit(n)


def filter_values(df: DataFrame, column: str) -> DataFrame:
    """Values of a column and how often they occur, none if the table is small."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    enough = df.limit(FILTER_ROWS).agg((F.count("*") >= FILTER_ROWS).alias("_e"))  # one row
    return counts.join(F.broadcast(enough), F.col("_e")).drop("_e")


def counter(shown: DataFrame, total: DataFrame, searching: bool) -> str:
    return f"{shown.count()} / {total.count()}" if searching else str(total.count())


def carry_forward(df: DataFrame, keys: list[str], order: str, value: Column, name: str) -> DataFrame:
    """The last value seen so far in each key's order."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("_v", value).withColumn(name, F.last("_v", ignorenulls=True).over(w)).drop("_v")


def local_rank(df: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(order)))


def group_headers(df: DataFrame, group: str, order: str) -> DataFrame:
    """Each row with its group's size, and whether it is the group's first; `order` tells the rows of a group apart.

    Groups are counted and their first rows found by partial aggregates, so a large one is not gathered."""
    own = df.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("group_size"), F.min(order).alias("_first"))
    met = df.join(own, F.col(group).eqNullSafe(F.col("_g")))
    return met.withColumn("is_header", F.col(order).eqNullSafe(F.col("_first"))).drop("_g", "_first")


def running_offset(df: DataFrame, keys: list[str], order: list[str], size: str, name: str) -> DataFrame:
    """Where each segment starts: the sum of the sizes before it."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(size).over(w), F.lit(0)))


def first_use(df: DataFrame, term: str, order: str) -> DataFrame:
    """The first row of each term."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(term).orderBy(order))).where("_n = 1").drop("_n")


def dominant(df: DataFrame, group: str, value: str, weight: str | None = None) -> DataFrame:
    """Each group's most frequent value; of equals, the greatest. weight: how many rows a row stands for."""
    counts = df.groupBy(group, value).agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    return counts.groupBy(group).agg(F.max_by(value, F.struct("n", value)).alias("dominant"))


def summary_by(df: DataFrame, columns: list[str], value: str) -> DataFrame:
    """Count, least and greatest of a value by each column alone, and in all."""
    sets = [[F.col(c)] for c in columns] + [[]]
    grouped = df.groupingSets(sets, *[F.col(c) for c in columns])
    return grouped.agg(F.count("*").alias("n"), F.min(value).alias("lowest"), F.max(value).alias("highest"), F.grouping_id().alias("level"))


def range_join(rows: DataFrame, ranges: DataFrame, key: str, lo: str, hi: str) -> DataFrame:
    """Rows with each whole-number range they lie in. Narrow ranges are spelt out and joined by equality."""
    narrow = ranges.where(F.col(hi) - F.col(lo) < WIDEST_RANGE).withColumn(key, F.explode(F.sequence(lo, hi)))
    met = rows.join(narrow, key)
    wide = ranges.where(F.col(hi) - F.col(lo) >= WIDEST_RANGE)
    if wide.isEmpty():
        return met
    return met.unionByName(rows.join(wide, F.col(key).between(F.col(lo), F.col(hi))).select(met.columns))


def monthly(df: DataFrame, date: str, span: DataFrame) -> DataFrame:
    """(month, n) for every month between span's a and z; a month without rows is a measured 0."""
    month = lambda c: F.trunc(c, "month")
    spine = span.select(F.explode(F.sequence(month("a"), month("z"), F.expr("interval 1 month"))).alias("month"))
    counts = df.groupBy(month(date).alias("month")).agg(F.count("*").alias("n"))
    return spine.join(counts, "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("n"))


def rolling_year(df: DataFrame, date: str) -> DataFrame:
    """(month, n, rolling): counts by month and over the twelve months up to it. One row for each month is ordered."""
    counts = df.groupBy(F.trunc(date, "month").alias("month")).agg(F.count("*").alias("n"))
    place = F.year("month") * 12 + F.month("month")
    w = Window.orderBy("_p").rangeBetween(-11, 0)
    return counts.withColumn("_p", place).withColumn("rolling", F.sum("n").over(w)).drop("_p")


def seasonal(series: DataFrame, key: str, month: str, value: str, ratio: bool = False) -> DataFrame:
    """Adds trend, seasonal and remainder to monthly series (key, month, value), a month of a key being one row.

    The trend is the centred mean of twelve months, the outer two of its thirteen counting half; it is null where one of
    them is not there, since a gap is no zero. The seasonal index of a calendar month is the mean of what the trend leaves over,
    moved so that the indices of a whole year sum up to none (ratio: multiplied, so that they have a mean of one); it is null
    for series without all twelve. Windows order one row for each month of a key."""
    place, tag = F.year(month) * 12 + F.month(month), ("_p", "_c", "_m", "_i", "_y")
    p, c, m, index, year = tag
    around = lambda lo, hi: Window.partitionBy(key).orderBy(p).rangeBetween(lo, hi)
    rows = series.withColumn(p, place).withColumn(c, F.month(month))
    ends = F.sum(value).over(around(-6, -6)) + F.sum(value).over(around(6, 6))
    whole = F.count(value).over(around(-6, 6)) == 13
    rows = rows.withColumn("trend", F.when(whole, (F.sum(value).over(around(-5, 5)) + ends / 2) / 12))
    left = F.col(value) / F.nullif("trend", F.lit(0)) if ratio else F.col(value) - F.col("trend")
    rows = rows.withColumn(m, left)
    means = rows.where(F.col(m).isNotNull()).groupBy(F.col(key).alias("_k"), F.col(c).alias("_d")).agg(F.avg(m).alias(index))
    whole_year = Window.partitionBy("_k")
    balanced = F.col(index) / F.col(year) if ratio else F.col(index) - F.col(year)
    means = means.withColumn(year, F.avg(index).over(whole_year)).withColumn("seasonal", F.when(F.count(index).over(whole_year) == 12, balanced))
    met = rows.join(means.select("_k", "_d", "seasonal"), F.col(key).eqNullSafe(F.col("_k")) & (F.col(c) == F.col("_d")), "left")
    rest = F.col(value) / (F.col("trend") * F.col("seasonal")) if ratio else F.col(value) - F.col("trend") - F.col("seasonal")
    return met.select(*series.columns, "trend", "seasonal", rest.alias("remainder"))


def breaks(series: DataFrame, order: str, value: str, window: int = 6, sigmas: float = 3.0) -> DataFrame:
    """Marks values that leave the mean of the `window` before them by more than `sigmas` deviations; too short a past is not judged."""
    w = Window.orderBy(order).rowsBetween(-window, -1)
    mean, sd, n = F.avg(value).over(w), F.stddev(value).over(w), F.count(value).over(w)
    return series.withColumn("is_break", F.when(n >= window, F.abs(F.col(value) - mean) > sigmas * sd))


def trend(series: DataFrame, x: str, y: str) -> DataFrame:
    return series.agg(F.regr_slope(y, x).alias("slope"), F.count("*").alias("n"))


def longest_gap(df: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """Days between the two neighbouring dates that lie furthest apart; null for a single date."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    return df.withColumn("_d", F.datediff(F.col(ts), F.lag(ts).over(w))).groupBy(key).agg(F.max("_d").alias("longest_gap"))


def cannibalised(df: DataFrame, query: str, page: str, least: int) -> DataFrame:
    """Pairs of pages that both have `least` rows for one query."""
    hits = df.groupBy(query, page).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    a, b = hits.select(query, F.col(page).alias("page_a")), hits.select(query, F.col(page).alias("page_b"))
    return a.join(b, query).where("page_a < page_b").select(F.col(query).alias("query"), "page_a", "page_b")
