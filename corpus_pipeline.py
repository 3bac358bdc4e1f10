"""A corpus cleaned in stages: each reads what the one before it wrote.

Quality classifier, exact copies, near copies, secrets, packing. All but the last return the columns of
``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.llm import bpe, exact_dedup, jaccard_join, packing, quality_classifier, secret_scan
from lakewarden.llm.common import small_batches, staged, table
from lakewarden.session import scratch_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; staged, as whole rows pass through Python in small Arrow batches."""
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality_classifier.with_score(docs, model, name="_quality_score")
    with small_batches(spark):
        return staged(scored.filter(F.col("_quality_score") >= quality_classifier.THRESHOLD).select(*docs.columns))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest id."""
    return exact_dedup.drop_duplicates(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    joined = jaccard_join.jaccard_join(docs)
    gone = joined.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == F.col("_gone"), "left_anti")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, found secrets replaced by a mark and the length brought up to date."""
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and places."""
    return packing.pack(docs, bpe.vocabulary_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", classified),
    ("exact_dedup", without_copies),
    ("ngram_jaccard_join", without_near_copies),
    ("secret_scan", without_secrets),
    ("best_fit_packing", packed),
]

ORACLE_SQL = None  # the classifier, the encoder and the packing are no SQL; tests/llm holds the stages to brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = scratch_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
