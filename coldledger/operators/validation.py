"""Validation of snapshots against what was stored of them, from the route to the outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..session import durable
from .catalogue import missing_message, next_state
from .manifests import compare_manifests


def _image_checks(routes: DataFrame, local_images: DataFrame, stored_images: DataFrame) -> DataFrame:
    """Whole-volume digests of both sides; a side without one does not match."""
    local = local_images.select("snapshot_id", F.col("hash").alias("left_hash"))
    stored = stored_images.select(F.col("key").alias("found_key"), F.col("hash").alias("right_hash"))
    compared = routes.where(F.col("route") == "image").join(local, "snapshot_id", "left").join(stored, "found_key", "left")
    ok = F.coalesce(F.col("left_hash") == F.col("right_hash"), F.lit(False))
    said = [F.coalesce(name, F.lit("none")) for name in ("right_hash", "left_hash")]
    return compared.select(
        *routes.columns,
        ok.alias("ok"),
        F.lit(None).cast("bigint").alias("files"),
        F.lit(None).cast("bigint").alias("differences"),
        F.when(~ok, F.format_string(fv.IMAGE_DIFFERS, *said)).alias("message"),
    )


def compare_archives(routes: DataFrame, local_files: DataFrame, stored_files: DataFrame) -> DataFrame:
    """Files of all partitions with a stored archive, paired by ``archive`` (its key) and name.

    ``local_files`` has ``snapshot_id, partition_name, filename, hash`` and ``stored_files`` has
    ``key, filename, hash``. Files of other partitions and keys are left out first.
    """
    archives = routes.where(F.col("route") == "archive").select(
        "snapshot_id", "partition_name", F.col("found_key").alias("archive")
    )
    local = local_files.join(archives, ["snapshot_id", "partition_name"]).select("archive", "filename", "hash")
    stored = stored_files.withColumnRenamed("key", "archive").join(archives.select("archive"), "archive", "left_semi")
    return compare_manifests(durable(local), durable(stored.select("archive", "filename", "hash")), ["archive"])


def partition_checks(
    routes: DataFrame,
    compared: DataFrame,
    local_images: DataFrame,
    stored_images: DataFrame,
    bucket: str,
) -> DataFrame:
    """``ok`` and ``message`` of each row of ``routes``, with the ``files`` of an archive and their ``differences``.

    ``compared`` is that of ``compare_archives``. An archive without files on either side matches.
    """
    per_archive = compared.groupBy("archive").agg(
        F.count_if(F.col("status") != "only_right").alias("files"),
        F.count_if(F.col("status") != "match").alias("differences"),
    )
    counted = [F.coalesce(name, F.lit(0).cast("bigint")).alias(name) for name in ("files", "differences")]
    archives = (
        routes.where(F.col("route") == "archive")
        .join(per_archive.withColumnRenamed("archive", "found_key"), "found_key", "left")
        .select(*routes.columns, *counted)
        .withColumn("ok", F.col("differences") == 0)
        .withColumn("message", F.when(~F.col("ok"), F.format_string(fv.ARCHIVE_DIFFERS, F.lit(bucket), F.col("found_key"))))
    )
    missing = routes.where(F.col("route") == "missing").select(
        "*",
        F.lit(False).alias("ok"),
        F.lit(None).cast("bigint").alias("files"),
        F.lit(None).cast("bigint").alias("differences"),
        missing_message(bucket).alias("message"),
    )
    return _image_checks(routes, local_images, stored_images).unionByName(archives).unionByName(missing)


def validation_outcomes(snapshots: DataFrame, checks: DataFrame, tag: str) -> DataFrame:
    """One row per snapshot: ``ok``, the ``message`` of its first partition that failed, and the tag it gets.

    A snapshot is validated when no check of it failed; one without partitions has none. ``checks``
    should be ``durable``.
    """
    failed = checks.where(~F.col("ok"))
    first = failed.groupBy("snapshot_id").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("failed"))
    reason = failed.select("snapshot_id", "place", "message").join(first, ["snapshot_id", "place"]).drop("place")
    done = checks.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("checked"))
    prior = F.element_at(F.filter("tags", lambda t: t["Key"] == tag), 1)["Value"]
    tagged = snapshots.select(
        "snapshot_id", F.when(F.exists("tags", lambda t: t["Key"] == tag), prior).alias("prior_tag")
    )
    outcomes = tagged.join(done, "snapshot_id", "left").join(reason, "snapshot_id", "left")
    ok = F.col("failed").isNull()
    return outcomes.select(
        "snapshot_id",
        F.lit("validate").alias("mode"),
        ok.alias("ok"),
        F.coalesce("checked", F.lit(0).cast("bigint")).alias("checked"),
        F.coalesce("failed", F.lit(0).cast("bigint")).alias("failed"),
        "message",
        "prior_tag",
        next_state(F.lit("validate"), ok, F.lit(False), F.col("prior_tag")).alias("new_tag"),
    )
