"""The registered queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import (
    bpe,
    clustering,
    decontamination,
    embedding_dedup,
    exact_dedup,
    extraction,
    mixing,
    near_dedup,
    quality,
    token_store,
    toxicity,
    warc,
    whitening,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup_report(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoding_report(_table(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract_text(_table(spark, sf_dir, "pages"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(_table(spark, sf_dir, "documents"), words=2)


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.stored_tokens(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(_table(spark, sf_dir, "pages")).drop("url")


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that lie inside passages of the benchmark."""
    return decontamination.contamination_report(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    )


def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of each usable vector after ten rounds."""
    return clustering.clustering_report(_table(spark, sf_dir, "embeddings"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen whitened coordinates of each usable vector."""
    return whitening.whitening_report(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_bpe": op2_bpe,
    "op3_html_text": op3_html_text,
    "op4_mix_sources": op4_mix_sources,
    "op5_quality": op5_quality,
    "op6_minhash_dedup": op6_minhash_dedup,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_token_store": op8_token_store,
    "op9_toxicity": op9_toxicity,
    "op10_warc": op10_warc,
    "op11_decontamination": op11_decontamination,
    "op12_clustering": op12_clustering,
    "op13_whitening": op13_whitening,
}
