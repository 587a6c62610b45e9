"""Corpus pipeline: quality rules, near-duplicates, decontamination, personal data, segmentation.

Each stage's result is written as Parquet in the shared folder and read again as the next one's input, so a stage that
loses executors repeats only itself. Null ids and texts, empty and very long texts, ties, repeated rows and further columns,
whatever their names, are treated as each stage says; an empty table runs through all of them and gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftlog.llm.common import materialize, table
from driftlog.llm.decontaminate import drop_contaminated
from driftlog.llm.pii import redact
from driftlog.llm.quality import keep_good
from driftlog.llm.queries import PIECE_MODEL
from driftlog.llm.segment import sample_segmentations
from driftlog.llm.simhash import drop_near_duplicates


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects. Null and empty texts are rejected as too short; repeated rows are judged alike."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, Jaccard 0.8 on five words: the smallest id, null ids last, then the
    smallest hash of the text. Of repeated rows one stays."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item. Null and empty texts hold none; null ids are judged together."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, identifiers replaced by their kind. Null and empty texts stay as they are."""
    return redact(docs)


def segmentation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each document, with their ids; one, of no pieces, of null and empty texts. Repeated rows
    get equal ones."""
    return sample_segmentations(docs, PIECE_MODEL, k=2, reuse=False)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("segmentation", segmentation),
]

#: Fingerprints, alignments and sampling are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
