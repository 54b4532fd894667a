"""Corpus pipeline: five operators over the documents, each on what the one before kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns the rows that it keeps, with
the columns of documents (the last one adds the copy's number). run() writes each stage's rows as Parquet under
the checkpoint folder, so no stage is computed again when its rows are read more than once or executors go; what a
stage wrote on its way is deleted then. Other columns of the documents are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, mixing, pii, quality_classifier, simhash
from tidemark.llm.common import checkpoint_dir, load, scratch, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    docs = docs.select(*COLUMNS)
    model = quality_classifier.trained(docs, load(spark, sf_dir, "labels").select("doc_id", "quality"))
    return quality_classifier.scored(docs, model).where("quality_score >= 0.5").select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts: five-word shingles, similarity of 0.8 or more."""
    return simhash.deduplicated(docs.select(*COLUMNS), similarity=0.8, shingle=5)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    bad = decontaminate.contaminated(docs, load(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("bad")).distinct()
    return docs.select(*COLUMNS).join(bad, F.col("doc_id").eqNullSafe(F.col("bad")), "left_anti")


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts sanitised and n_chars counted again."""
    return pii.sanitised(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, with copy_no from 1."""
    return mixing.mixed(docs.select(*COLUMNS))


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("PII", pii_stage),
    ("mixing sources to target weights", mix_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), f"stage{i}", checkpoint_dir(spark))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier and the fingerprints can't be expressed in SQL; tests/llm/test_pipeline.py checks each stage.
ORACLE_SQL = None
