"""Documents to training tokens: the stages of the corpus pipeline.

Quality first, so that everything after it works on what is worth keeping; copies before near
copies; the mix over what is left; tokens last. All stages but the last return the columns of
``documents``.

A stage's result is to be written before the next stage is called, as ``run`` does: the tables
that a stage has staged are deleted when the next one starts, so the corpus is not kept once
more for every stage. They stay if the next stage's input still reads them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coldledger.llm import bpe, exact_dedup, mixing, near_dedup, quality
from coldledger.llm.arrays import free_name
from coldledger.session import Staging, delete_folder, new_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: What the last stage of each application has staged.
_staging: dict[str, Staging] = {}


def _release(spark: SparkSession, docs: DataFrame | None = None) -> Staging:
    """The application's staging, emptied of all but what ``docs`` reads."""
    staging = _staging.setdefault(spark.sparkContext.applicationId, Staging())
    files = docs.inputFiles() if docs is not None and staging.folders else []
    if not any(folder.rsplit("/", 1)[-1] in file for folder in staging.folders for file in files):
        staging.release(spark)
    return staging


def _staged(work: Stage) -> Stage:
    @wraps(work)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with _release(spark, docs).recording():
            return work(spark, docs, sf_dir)

    return stage


@_staged
def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_staged
def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, the one with the largest id."""
    return exact_dedup.exact_dedup(docs)


@_staged
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return near_dedup.near_dedup(docs)


@_staged
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as far, as the target weights of their sources take them."""
    mixed = mixing.mix_documents(docs)
    return mixed.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in mixed.columns else mixed


@_staged
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with their hash and that of the text they decode to.

    Where ``docs`` has a column of such a name, the added one's has underscores at its end.
    """
    found = bpe.encode_documents(docs)
    others = [F.col(f"kept_columns.`{name}`").alias(name) for name in docs.columns if name != "text"]
    added = ["n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    return found.select(*others, *[F.col(name).alias(free_name(docs, name)) for name in added])


STAGES = [
    ("quality classifier", drop_low_quality),
    ("exact dedup", drop_exact_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: The classifier's scores, the draws of the mix and the token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written as Parquet and read again.

    Only the last stage's rows are left in the shared folder.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES:
        path = new_folder(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete_folder(spark, before)
        before = path
    _release(spark)
    return docs
