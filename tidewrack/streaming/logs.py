"""Agent hits in windows of time, over a stream of log rows. An extension: batch logs are the reference behaviour."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.functions.numbers import half_even


def read_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def windowed_breakdown(hits: DataFrame, ts: str, agent: str, status: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Hits and failure rate by agent and window; rows later than the watermark are left out. Works on batches as well."""
    failed = F.count_if(~F.col(status).between(200, 399))
    rows = hits.withWatermark(ts, late).groupBy(F.window(ts, window), agent).agg(F.count("*").alias("hits"), failed.alias("failed"))
    return rows.select(F.col("window.start").alias("start"), agent, "hits", "failed", half_even(F.col("failed") / F.col("hits"), 3).alias("failure_rate"))


def visits(hits: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Runs of hits of one key with no gap longer than `gap`."""
    rows = hits.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("hits"))
    return rows.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "hits")
