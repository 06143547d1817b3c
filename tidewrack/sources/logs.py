"""Access-log lines in the Combined Log Format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = r'^(\S+) \S+ \S+ \[([^\]]+)\] "([A-Z]+) (\S+)[^"]*" (\d{3}) (\S+) "([^"]*)" "([^"]*)"'
FIELDS = ("ip", "date", "method", "path", "status", "size", "referer", "user_agent")
SAMPLES, SAMPLE_CHARS = 3, 200


def read(spark: SparkSession, path: str) -> DataFrame:
    """(line) rows of plain or gzipped logs."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def parse(lines: DataFrame, line: str = "line") -> DataFrame:
    """Adds the fields of each line, and `recognised`; blank lines are left out, and fields of unknown lines are null."""
    rows = lines.where(F.trim(line) != "").withColumn("recognised", F.col(line).rlike(LINE))
    for i, f in enumerate(FIELDS, 1):
        rows = rows.withColumn(f, F.when(F.col("recognised"), F.regexp_extract(line, LINE, i)))
    return rows.withColumn("status", F.col("status").cast("int"))


def counters(parsed: DataFrame, line: str = "line", agent: str | None = None, order: str | None = None) -> DataFrame:
    """Lines read, recognised (those of a named agent, if `agent` is given) and ignored, and samples of ignored lines: the first by `order`, or by their text."""
    known = F.col("recognised") & F.col(agent).isNotNull() if agent else F.col("recognised")
    bad = F.when(~F.col("recognised"), F.substring(line, 1, SAMPLE_CHARS))
    totals = parsed.agg(F.count("*").alias("read"), F.count_if(known).alias("recognised"), F.count_if(~F.col("recognised")).alias("ignored"))
    first = parsed.where(~F.col("recognised")).select(F.col(order or line).alias("o"), bad.alias("s")).orderBy("o", "s").limit(SAMPLES)
    return totals.join(first.agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "s"))), lambda x: x["s"]).alias("samples")))
