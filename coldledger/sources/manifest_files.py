"""Manifest files: ``hash SPACE filename NUL`` records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.paths import manifest_record, record_is_short


def _records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\0").text(path).select(F.col("value").cast("binary").alias("record"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Names stay bytes. Reading a record too short to hold a hash fails the job."""
    record = F.col("record")
    problem = F.concat(
        F.lit("manifest record of "),
        F.octet_length(record).cast("string"),
        F.lit(f" bytes, shorter than {fv.MIN_RECORD_BYTES}"),
    )
    checked = F.when(record_is_short(record), F.raise_error(problem).cast("binary")).otherwise(record)
    return (
        _records(spark, path)
        .select(checked.alias("record"))
        .select(
            F.substring("record", fv.MIN_RECORD_BYTES + 1, 2**31 - 1).alias("filename"),
            F.substring("record", 1, fv.HASH_CHARS).cast("string").alias("hash"),
        )
    )


def short_records(spark: SparkSession, path: str) -> DataFrame:
    """Records that ``read_manifest`` would fail on."""
    return _records(spark, path).where(record_is_short(F.col("record")))


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.select(manifest_record(F.col("hash"), F.col("filename")).alias("value")).write.option(
        "lineSep", "\0"
    ).text(path)
