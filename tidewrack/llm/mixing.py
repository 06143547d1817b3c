"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key, -ln(u) / quality weight, with u from a hash of its id, so reruns
agree. A source's token target is met by complete epochs over all its documents first; what remains is a
sample without replacement: documents in key order, prefix sums of their sizes, up to the remaining budget.
The prefix sum is taken over fixed key buckets, so a source with a third of all rows is never sorted in one
task: only the documents of the bucket in which the budget ends are ordered one by one.

Edge cases: a null or empty text has size 0 and is taken for 0 words; sources are ordered by code point
with null last, null being a source of its own; a document without a quality label, or with several,
weighs as DEFAULT_QUALITY or as the best of them; a row with a null id is keyed by its text; repeated rows
tie in the key and are taken one after another by mix, and together by mix_rows; a very long text is one row of
its size, so a source misses its target by half of its largest text at most; other columns, whatever their names, are
not read by mix and stay as they are in mix_rows; an empty table gives no rows.

The windows without a partition order one row for each source: a source is a name and two numbers there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.llm.common import WorkArea

WORD = r"[^\x20\x09-\x0D]+"
SOURCE_WEIGHTS = (3, 1, 2)
QUALITY_WEIGHTS, DEFAULT_QUALITY = {1: 1.0, 0: 0.5}, 0.75
BUCKETS = 4096


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = SOURCE_WEIGHTS) -> DataFrame:
    """(source, source_size) -> with weight and target: share x all sizes by weight, none above most x its size.

    What a source can't take is shared among the others by weight, again and again: the sources fill up in
    the order of most x size / weight, and the level at which the rest stay below their limit is found by
    prefix sums over that order. One row per source."""
    named = Window.orderBy(F.col("source").asc_nulls_last())
    filling = Window.orderBy("fills_at", F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(named) - 1) % len(weights) + 1).cast("int"))
    out = sizes.withColumn("weight", weight).withColumn("limit", F.lit(most) * F.col("source_size")).withColumn("fills_at", F.col("limit") / F.col("weight"))
    out = out.withColumn("full", F.coalesce(F.sum("limit").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    out = out.withColumn("left", F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing)))
    out = out.withColumn("level", (F.lit(share) * F.sum("source_size").over(Window.partitionBy()) - F.col("full")) / F.col("left"))
    level = F.min(F.when(F.col("level") <= F.col("fills_at"), F.struct("fills_at", "level"))).over(Window.partitionBy())
    return out.withColumn("at", level["level"]).select("source", "source_size", "weight", F.when(F.col("at").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("at") * F.col("weight"))).alias("target"))


def sampling_key(name: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / weight; u in (0, 1) from 52 bits of an MD5 of the seed and the row's name."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 1) / F.lit(float(2**52 + 1))) / weight


def row_name() -> Column:
    """The id as text, or for a row without one a hash of its text."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(df: DataFrame, quality: DataFrame | None = None, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = SOURCE_WEIGHTS, seed: int = 9) -> DataFrame:
    """Gives size, source_size, target, copies (complete epochs), partial (in the last epoch) and taken for each row of (doc_id, source, text).

    quality: (doc_id, quality) rows, 1 good and 0 poor."""
    sized = df.select("doc_id", "source", word_count().alias("size"), row_name().alias("name"))
    return _mix(sized, quality, share, most, weights, seed).drop("name")


def mix_rows(df: DataFrame, quality: DataFrame | None = None, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = SOURCE_WEIGHTS, seed: int = 9) -> DataFrame:
    """The rows of (doc_id, source, text, ...) that the mix takes, all columns, with size, copies, partial and taken.

    Rows alike in id, source and text are taken or left together, and the budget pays for all of them. A column of the
    mix whose name the input has already gets "mix_" before it."""
    tag = uuid.uuid4().hex[:8]
    own = {"doc_id": f"id_{tag}", "source": f"source_{tag}", "name": f"name_{tag}", "hash": f"hash_{tag}"}
    named = df.withColumns({own["name"]: row_name(), own["hash"]: F.xxhash64(F.coalesce("text", F.lit("")))})
    units = named.select("doc_id", "source", F.col(own["name"]).alias("name"), F.col(own["hash"]).alias("hash"), word_count().alias("size"))
    units = units.groupBy("doc_id", "source", "name", "hash").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    taken = _mix(units, quality, share, most, weights, seed).where("copies > 0 or partial")
    size = F.expr("size div rows")
    columns = {"size": size, "copies": F.col("copies"), "partial": F.col("partial"), "taken": F.expr("taken div rows")}
    free = {}
    for c in columns:
        name = c
        while name in df.columns:
            name = f"mix_{name}"
        free[c] = name
    found = taken.select(*[F.col(c).alias(own[c]) for c in own], *[v.alias(f"{c}_{tag}") for c, v in columns.items()])
    found = found.withColumnsRenamed({own["name"]: f"of_{tag}", own["hash"]: f"same_{tag}"})
    # Names are never null, so rows without an id meet by theirs.
    met = named.join(found, (F.col(own["name"]) == F.col(f"of_{tag}")) & (F.col(own["hash"]) == F.col(f"same_{tag}")) & F.col("source").eqNullSafe(F.col(own["source"])))
    return met.select(*[F.col(c) for c in df.columns], *[F.col(f"{c}_{tag}").alias(free[c]) for c in columns])


def _mix(sized: DataFrame, quality: DataFrame | None, share: float, most: float, weights: tuple[int, ...], seed: int) -> DataFrame:
    """Adds source_size, target, copies, partial and taken to (doc_id, source, size, name, ...)."""
    work = WorkArea(sized.sparkSession, "mixing")
    more = [c for c in sized.columns if c not in ("doc_id", "source", "size")]
    if quality is None:
        sized = sized.withColumn("w", F.lit(DEFAULT_QUALITY))
    else:
        best = quality.where("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("q")).select(F.col("doc_id").alias("of"), "q")
        rated = F.when(F.col("q") == 1, QUALITY_WEIGHTS[1]).when(F.col("q") == 0, QUALITY_WEIGHTS[0]).otherwise(DEFAULT_QUALITY)
        # Labels grow with the documents, so they are never broadcast. Rows without an id spread over salts, which no label has.
        salt = F.when(F.col("doc_id").isNull(), F.xxhash64("name") % 1024 + 1024).otherwise(F.lit(0))
        met = sized.withColumn("salt", salt).join(best.withColumn("none", F.lit(0).cast("long")).hint("merge"), (F.col("doc_id") == F.col("of")) & (F.col("salt") == F.col("none")), "left")
        sized = met.select("doc_id", "source", "size", rated.alias("w"), *more)
    keyed = sized.withColumn("key", sampling_key(F.col("name"), F.col("w"), seed))
    # exp(-key) falls from 1 to 0 as the key grows, so the buckets follow the order of the keys.
    keyed = work.write(keyed.withColumn("bucket", F.floor((1 - F.exp(-F.col("key"))) * BUCKETS).cast("int")).drop("w"), "keyed")
    buckets = work.write(keyed.groupBy("source", "bucket").agg(F.sum("size").alias("held")), "buckets")
    targets = source_targets(buckets.groupBy("source").agg(F.sum("held").alias("source_size")), share, most, weights)
    targets = targets.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    targets = targets.withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size"))
    before = F.coalesce(F.sum("held").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    plan = buckets.withColumn("before", before).alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")))
    # Buckets up to `full` are taken whole, and the budget ends within bucket `last`, if it ends within one.
    whole, ends = F.col("before") + F.col("held") <= F.col("budget"), (F.col("before") < F.col("budget")) & (F.col("before") + F.col("held") > F.col("budget"))
    plan = plan.groupBy(F.col("b.source").alias("s")).agg(
        *[F.max(c).alias(c) for c in ("source_size", "target", "copies", "budget")], F.coalesce(F.max(F.when(whole, F.col("bucket"))), F.lit(-1)).alias("full"),
        F.max(F.when(ends, F.col("bucket"))).alias("last"), F.max(F.when(ends, F.col("before"))).alias("before"),
    )
    plan = work.write(plan, "plan")  # one row for each source
    placed = keyed.join(plan, F.col("source").eqNullSafe(F.col("s")))
    in_last = F.coalesce(F.col("bucket") == F.col("last"), F.lit(False))
    within = Window.partitionBy("source", "bucket").orderBy("key", "name", "size").rowsBetween(Window.unboundedPreceding, -1)
    last = placed.where(in_last).withColumn("prior", F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    last = last.withColumn("partial", F.col("prior") + F.col("size") / 2 <= F.col("budget")).drop("prior")
    out = placed.where(~in_last).withColumn("partial", F.col("bucket") <= F.col("full")).unionByName(last)
    taken = F.col("copies") * F.col("size") + F.when(F.col("partial"), F.col("size")).otherwise(0)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", "partial", taken.cast("long").alias("taken"), *more)


ORACLE = f"""
WITH sized AS (
  SELECT d.doc_id, d.source, coalesce(CAST(d.doc_id AS VARCHAR), 'text ' || md5(coalesce(d.text, ''))) AS name, len(regexp_extract_all(coalesce(d.text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         CASE q.q WHEN 1 THEN {QUALITY_WEIGHTS[1]}::DOUBLE WHEN 0 THEN {QUALITY_WEIGHTS[0]}::DOUBLE ELSE {DEFAULT_QUALITY}::DOUBLE END AS w
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels WHERE quality IN (0, 1) GROUP BY 1) q ON d.doc_id = q.doc_id
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY 1
), weighed AS (
  SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight, 2.0::DOUBLE * source_size AS lim FROM sources
), filling AS (
  SELECT *, lim / weight AS fills_at,
         coalesce(sum(lim) OVER (ORDER BY lim / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
         sum(weight) OVER (ORDER BY lim / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
         CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM weighed
), levels AS (
  SELECT *, (1.5::DOUBLE * total - filled) / rest AS level FROM filling
), targets AS (
  SELECT source, source_size, coalesce(least(lim, (SELECT arg_min(level, fills_at) FROM levels WHERE level <= fills_at) * weight), lim) AS target FROM levels
), budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM targets
), keyed AS (
  SELECT *, -ln((CAST('0x' || substr(md5('9:' || name), 1, 13) AS BIGINT) + 1) / 4503599627370497.0::DOUBLE) / w AS key FROM sized
), placed AS (
  SELECT k.doc_id, k.size, b.source_size, b.target, b.copies, b.target - b.copies * b.source_size AS budget,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.name, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior
  FROM keyed k JOIN budgets b ON k.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(copies * size + CASE WHEN prior + size / 2.0::DOUBLE <= budget THEN size ELSE 0 END AS BIGINT) AS taken
FROM placed
"""
