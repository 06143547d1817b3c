"""The queries of the training-data operators over the driver's tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.llm import decontaminate, htmltext, infill, licenses, lines, media, mixing, repeats, secrets, simhash, tokens, toxicity, variants
from tidewrack.llm.common import read_table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read_table(spark, sf_dir, "documents"))


def op2_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest_columns(spark, read_table(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.withColumn("score", F.round("score", 6))


def op4_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    return tokens.attribute(read_table(spark, sf_dir, "documents"), rule="majority", encoder=tokens.Encoder(vocabulary))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(spark, read_table(spark, sf_dir, "documents"), k=3, radius=2)
    return found.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    model = toxicity.fit(documents, read_table(spark, sf_dir, "labels"))
    scored = toxicity.score(documents, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "spans")


def op8_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repeats.deduplicate(read_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_removed") > 0).alias("repeated"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(read_table(spark, sf_dir, "pages"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.deduplicate(read_table(spark, sf_dir, "documents"), least_documents=10, least_chars=1)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group(read_table(spark, sf_dir, "documents"), least_length=6, least_count=5, ratio=5, misprint_every=199)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.transform(read_table(spark, sf_dir, "documents"), seed=42, rate=50, spm_rate=80)
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(infill.restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_media_chunks, op3_benchmark_decontamination, op4_token_counts, op5_license_scan, op6_simhash_near_dedup, op7_toxicity, op8_repeated_bytes, op9_source_mixing, op10_main_text, op11_line_dedup, op12_spelling_variants, op13_fill_in_middle)}
ORACLES = {"op2_media_chunks": media.ORACLE, "op3_benchmark_decontamination": decontaminate.ORACLE, "op10_main_text": htmltext.ORACLE, "op5_license_scan": licenses.ORACLE, "op8_repeated_bytes": repeats.ORACLE, "op9_source_mixing": mixing.ORACLE, "op11_line_dedup": lines.ORACLE, "op12_spelling_variants": variants.ORACLE, "op13_fill_in_middle": infill.ORACLE}
