"""The corpus pipeline: quality, exact copies, near copies, secrets, packing; each stage rereads the last one's Parquet."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from freshet.llm import best_fit, extendible, fourier_quality, lsh_forest, secret_scan
from freshet.llm.common import small_batches, table
from freshet.session import checkpoint_root

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated quality score reaches the threshold."""
    small_batches(spark)
    model = fourier_quality.fit_on_labels(fourier_quality.statistics_of(docs), table(spark, sf_dir, "labels"))
    return docs.where(fourier_quality.score_of(F.col("text"), model) >= fourier_quality.ACCEPT).select(*COLUMNS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text, the one with the smallest doc_id."""
    return extendible.drop_copies(docs).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents connected by a Jaccard similarity of 0.8 or more, the one with the smallest doc_id."""
    small_batches(spark)
    return lsh_forest.drop_near_copies(docs).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts and n_chars counted anew."""
    small_batches(spark)
    chances = secret_scan.train(secret_scan.labelled_samples(docs))
    clean = docs.withColumn("text", secret_scan.masked(F.col("text"), chances))
    return clean.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of every document lies in the training sequences."""
    small_batches(spark)
    # workers outlive the stages before, so they keep a smaller cache and shorter arrays than packing alone would
    return best_fit.pack_documents(docs, keep_words=20_000, text_bytes=1 << 20)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("secret scan", secrets),
    ("best-fit packing", packing),
]

# The classifier, the similarity join and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`; every stage's rows are written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = f"{checkpoint_root(spark)}/freshet-stage-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
