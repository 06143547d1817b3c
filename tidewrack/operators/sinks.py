"""Writers that refuse, verify, or keep what was there before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.operators import rules, scoring, snapshot
from tidewrack.operators.graph import cut_lineage
from tidewrack.operators.migrate import lossless


def write_snapshot(documents: DataFrame, path: str, schema: dict, body: str = "body") -> None:
    """JSON documents, if all of them meet the contract; otherwise nothing is written."""
    documents = cut_lineage(documents)  # judged and written from the same rows
    bad = snapshot.contract_violations(documents, schema, body).where(F.size("violations") > 0).select("violations").limit(5).collect()
    if bad:
        raise ValueError(f"the contract is broken: {[v for r in bad for v in r['violations']][:10]}")
    documents.select(F.col(body).alias("value")).write.text(path)


def write_actions(actions: DataFrame, path: str) -> None:
    """Scored actions as one CSV file with fixed columns, all or none: a list that people read, in one task."""
    scoring.refuse_invalid(actions)
    rows = actions.withColumn("score", scoring.score(F.col("gain").cast("int"), F.col("confiance").cast("int"), F.col("effort").cast("int")))
    rows.select(*scoring.COLUMNS).orderBy(F.desc("score"), "id").coalesce(1).write.csv(path, header=True)


def write_partitioned(df: DataFrame, path: str, *keys: str) -> None:
    """Writes by key. A key's folder is replaced whole and others stay, so a rerun gives the same rows and no second ones."""
    df.write.partitionBy(*keys).mode("overwrite").option("partitionOverwriteMode", "dynamic").json(path)


def write_verified(df: DataFrame, path: str, before: DataFrame, ignore: list[str]) -> DataFrame:
    """Writes beside the old rows, reads back, and returns what was read only if no cell but the ignored ones differs."""
    df.write.parquet(path)
    after = df.sparkSession.read.parquet(path)
    if not lossless(before, after, ignore):
        raise ValueError("rows were lost or changed by the rewrite")
    return after


def next_version(existing: list[str], day: str, digest: str, digests: dict[str, str]) -> str | None:
    """The name of a day's next version, a to z; None if its latest version has the same content."""
    letters = sorted(v.removeprefix(day) for v in existing if v.startswith(day))
    if letters and digests.get(day + letters[-1]) == digest:
        return None
    if letters and letters[-1] == "z":
        raise ValueError("a day has no more than 26 versions")
    return day + (chr(ord(letters[-1]) + 1) if letters else "a")


def verdict_json(checks: DataFrame) -> DataFrame:
    """The envelope of checks as one JSON text, from the same rows that a report lists."""
    return rules.envelope(checks).select(F.to_json(F.struct("*")).alias("value"))
