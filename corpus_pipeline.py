"""The corpus pipeline: documents go through quality, toxicity, near-duplicate and secret stages, then are packed.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
before the next one reads it. All but the last return the columns of documents.
"""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import jaccard_join, packing, quality, secrets, toxicity
from plumbline.llm.common import table, written


#: Rows of an Arrow batch in these stages: rows are whole texts, and both sides of a Python worker hold a batch.
BATCH_ROWS = 1000


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on this stage's labelled input, does not reject."""
    _small_batches(spark)
    return quality.filter_documents(docs, table(spark, sf_dir, "labels"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier, fitted on this stage's labelled input, does not call toxic."""
    _small_batches(spark)
    return toxicity.filter_documents(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least doc_id, of each group of near copies."""
    _small_batches(spark)
    return jaccard_join.one_of_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets replaced by a mark; n_chars is that of the new text."""
    _small_batches(spark)
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed training sequences."""
    _small_batches(spark)
    return packing.pack(docs, Path(public_tokenizers.path("word_bpe_49k.json")).read_text())


STAGES = [
    ("quality_classifier", keep_good),
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("secret_scans", redact_secrets),
    ("packing", pack_sequences),
]

#: Trained models and a tokenizer can't be said in SQL; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's output written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
