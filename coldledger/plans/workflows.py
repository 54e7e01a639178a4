"""The three jobs a user runs whole: cost analysis, validation, queue processing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import costs, manifests, usage
from ..session import durable
from ..sources.archives import read_archives
from ..sources.directories import hash_directory
from ..sources.usage_csv import read_usage_report


def cost_tables(
    report: DataFrame, snapshots: DataFrame, volumes: DataFrame, regions: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Latest usage, described snapshots and volume rollup, each written out.

    The report is scanned once, for the first of them.
    """
    parsed = usage.in_regions(usage.parse_usage(report), regions)
    latest = durable(usage.latest_usage(parsed))
    described = durable(costs.with_snapshots(latest, snapshots))
    return latest, described, durable(costs.volume_rollup(described, volumes))


def analyse_report(
    spark: SparkSession,
    paths: str | Sequence[str],
    snapshots: DataFrame,
    volumes: DataFrame,
    regions: Sequence[str] | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """The cost report of usage report files, as numbered lines. ``multi_line`` as in ``read_usage_report``."""
    report = read_usage_report(spark, paths, multi_line)
    return costs.report_lines(*cost_tables(report, snapshots, volumes, regions))


def archive_manifest(spark: SparkSession, archives: Sequence[str]) -> DataFrame:
    """Manifest of archives on a mounted path; fails at an unresolved hard link."""
    paths = spark.createDataFrame([(path,) for path in archives], "archive string")
    # Members are written out, as hashing them is the work and links read them twice.
    members = durable(read_archives(spark, paths))
    return manifests.require_resolved(manifests.resolve_hard_links(members))


def validate_directory(spark: SparkSession, directory: str, archives: Sequence[str]) -> DataFrame:
    """Compare a directory (left) with the archives made from it (right)."""
    local = durable(hash_directory(spark, directory))
    stored = durable(archive_manifest(spark, archives))
    return durable(manifests.compare_manifests(local, stored))


def validate_image(originals: DataFrame, images: DataFrame) -> DataFrame:
    """Whole-volume digests per snapshot with a verdict and, if unequal, a message."""
    message = F.concat(
        F.lit("Hash of stored image ("),
        F.col("right_hash"),
        F.lit(") does not match the original ("),
        F.col("left_hash"),
        F.lit(")"),
    )
    compared = manifests.compare_digests(originals, images, "snapshot_id")
    return compared.withColumn("message", F.when(~F.col("equal"), message))
