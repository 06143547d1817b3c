"""A training corpus from documents: five stages, each over all that the one before kept.

Edge cases, the same in every stage: null, empty and very long texts are read whole, a null text as an empty one; nulls
in any other column are kept; ids may be null or repeat, rows being told apart by id and text; repeated rows and copies
meet in the near-dedup stage, which keeps one (the smallest id, then the smallest hash of the text), and before it are
judged alike; further columns, whatever their names, are passed on as they are; an empty table gives an empty one. The
stage functions say what they add."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewrack.llm import decontaminate, mixing, secrets, simhash, toxicity
from tidewrack.llm.common import WorkArea, read_table

TOXIC = 0.3


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagger scores TOXIC or more go."""
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model, TOXIC)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies stays; copies have 5-word shingles of a Jaccard similarity of 0.8 or more."""
    return simhash.keep_one(spark, docs, simhash.near_copies(spark, docs))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; every document stays."""
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with how often: copies whole epochs, and once more where partial."""
    return mixing.mix_rows(docs, read_table(spark, sf_dir, "labels"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("secret_scan", secrets_stage),
    ("source_mixing", mixing_stage),
]
#: SQL can't express the tagger or the forest; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the stages leave of documents; each stage's rows are written and read again."""
    work = WorkArea(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = work.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
