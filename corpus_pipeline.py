"""The corpus pipeline: quality, near copies, benchmark leaks, secrets, pieces.

Every stage takes (spark, docs, sf_dir) and works on all rows of `docs`; all but the
last return the columns of documents.  run() writes each stage's rows to the shared
folder and reads them again, so a lost executor never repeats earlier stages; what a
stage wrote on its way goes once its rows are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.llm import decontaminate, jaccard_join, quality_classifier, secret_scan, sentence_pieces, shared


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality_classifier.score(docs, model, "_quality")
    return scored.where(F.col("_quality") >= quality_classifier.THRESHOLD).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id, once if its row is repeated.

    Texts without words link with nothing and stay; of a group without any id one stays.
    """
    return jaccard_join.one_of_each(docs).select(*docs.columns)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, live-looking credentials replaced; n_chars follows the text."""
    clean = secret_scan.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast("long"))
    return clean.select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the SentencePiece ids of the text and their number."""
    coded = sentence_pieces.encode(docs.select("doc_id", "text"))
    return coded.select("doc_id", "pieces", F.size("pieces").cast("long").alias("n_pieces"))


STAGES = [
    ("quality_classifier", quality),
    ("jaccard_join", near_copies),
    ("decontaminate", leaks),
    ("secret_scan", secrets),
    ("sentence_pieces", pieces),
]

#: SQL can express neither the classifier nor the piece search: see test_pipeline in tests/llm/test_models.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with shared.passing(spark):
            docs = shared.keeping(stage(spark, docs, sf_dir), name)
    return docs
