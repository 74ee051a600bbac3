"""The registered queries of this subpackage: op1 to op13 and the pipeline."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, embedding_dedup, html_text, jaccard_join, line_dedup, media, packing, quality, secrets, spelling, token_counts, toxicity, whitening
from .common import table


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similarity_components(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = Path(public_tokenizers.path("byte_bpe_50k.tiktoken")).read_bytes()
    return bpe.encode_documents(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), Path(public_tokenizers.path("word_bpe_49k.json")).read_text())


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), Path(public_tokenizers.path("byte_bpe_50k.json")).read_text())


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_embedding_near_dedup, op2_secret_scans, op3_jaccard_join, op4_byte_bpe, op5_toxicity, op6_packing, op7_html_extraction, op8_quality, op9_media_columns, op10_token_counts, op11_line_dedup, op12_spelling_variants, op13_embedding_whitening)}


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_near_dedup": embedding_dedup.near_duplicates_sql(), "op2_secret_scans": secrets.digest_sql(), "op3_jaccard_join": jaccard_join.components_sql(), "op11_line_dedup": line_dedup.digest_sql(), "op12_spelling_variants": spelling.variants_sql()}
