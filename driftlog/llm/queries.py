"""op queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlog.llm.common import table


def op1_hpy_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftlog.llm.hpylm import train_and_score

    return train_and_score(table(spark, sf_dir, "documents"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftlog.llm.simhash import fp_hex, simhash_groups

    g = simhash_groups(table(spark, sf_dir, "documents"))
    return g.select("doc_id", fp_hex("fp").alias("fingerprint"), "component_id")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftlog.llm.passages import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def op4_kd_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftlog.llm.kdtree import kd_shards

    s = kd_shards(table(spark, sf_dir, "documents"), 24)
    null = F.lit(None).cast("int")
    return s.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", null.alias("grown_shard"))


#: A public model's file; its path on the driver is a parameter.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op5_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftlog.llm.segment import sample_segmentations

    return sample_segmentations(table(spark, sf_dir, "documents"), PIECE_MODEL, k=2)


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftlog.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftlog.llm.quality import quality_report

    q = quality_report(table(spark, sf_dir, "documents"))
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftlog.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftlog.llm.common import held_out
    from driftlog.llm.toxicity import score, train

    docs = table(spark, sf_dir, "documents")
    out = score(docs, *train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id"), 3).alias("held_out"), "score", "predicted")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftlog.llm.pii import digest, with_spans

    return digest(with_spans(table(spark, sf_dir, "documents")))


def queries() -> dict:
    return {f.__name__: f for f in (op1_hpy_language_model, op2_simhash_near_dedup, op3_substring_dedup, op4_kd_tree_sharding, op5_sentencepiece_sampling, op6_benchmark_decontamination, op7_quality_rules, op8_license_scans, op9_toxicity, op10_pii)}


def oracle_sql() -> dict[str, str]:
    from driftlog.llm import licenses, quality

    return {"op7_quality_rules": quality.ORACLE, "op8_license_scans": licenses.ORACLE}
