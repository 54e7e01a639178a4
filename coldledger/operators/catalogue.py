"""Queries over a snapshot catalogue: queues, lookups, tags, states and outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.keys import archive_base, full_key, image_base, key_base, key_codec, key_encrypted
from ..functions.tags import has_tag, legal_text
from ..functions.text import utc_iso
from ..session import durable
from .skew import with_positions


# --- queues and missing ids ---------------------------------------------------
def work_queue(snapshots: DataFrame, tag: str, state: str, owner_id: str) -> DataFrame:
    """Completed snapshots of one owner whose tag has the given state."""
    return snapshots.where(
        (F.col("status") == fv.STATUS_COMPLETED)
        & (F.col("owner_id") == owner_id)
        & has_tag(F.col("tags"), tag, state)
    )


def next_in_queue(queue: DataFrame) -> DataFrame:
    """The oldest snapshot of a queue, as at most one row."""
    return queue.orderBy("start_time", "snapshot_id").limit(1)


def missing_snapshots(requested: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Requested ids that no snapshot has, with how often each was requested.

    Requests are counted per id first, so a much requested id is one row.
    """
    wanted = requested.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("requests"))
    return wanted.join(snapshots.select("snapshot_id"), "snapshot_id", "left_anti")


def requested_snapshots(requested: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The snapshots that were requested by id, whatever their tags."""
    wanted = requested.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("requests"))
    return snapshots.join(wanted, "snapshot_id", "left_semi")


# --- object keys and lookups --------------------------------------------------
def _identity() -> tuple[Column, Column, Column, Column]:
    return F.col("volume_id"), F.col("start_time"), F.col("snapshot_id"), F.col("description")


def with_image_key(snapshots: DataFrame) -> DataFrame:
    """Add the key base of each snapshot's volume image."""
    return snapshots.withColumn("key_base", image_base(*_identity()))


def with_archive_key(snapshots: DataFrame) -> DataFrame:
    """Add the key base of each (snapshot, ``partition_name``) archive."""
    return snapshots.withColumn("key_base", archive_base(*_identity(), F.col("partition_name")))


def find_objects(wanted: DataFrame, objects: DataFrame, bucket: str, codec: str, encrypted: bool) -> DataFrame:
    """The stored object of each wanted ``key_base``, if there is one.

    A snapshot may have been stored in either codec, encrypted or not. Rather
    than try four keys per snapshot, the listing is split into base, codec and
    encryption, and combined to the preferred object per base: the configured
    encryption first, then the configured codec.
    """
    codec_rank = F.when(F.col("codec") == codec, 0).otherwise(1)
    encryption_rank = F.when(F.col("encrypted") == F.lit(encrypted), 0).otherwise(2)
    split = objects.where(F.col("bucket") == bucket).select(
        key_base(F.col("key")).alias("key_base"),
        key_codec(F.col("key")).alias("codec"),
        key_encrypted(F.col("key")).alias("encrypted"),
        "size",
    )
    best = (
        split.where(F.col("key_base") != "")
        .withColumn("rank", codec_rank + encryption_rank)
        .groupBy("key_base")
        .agg(F.min("rank").alias("rank"), F.min_by("size", "rank").alias("size"))
    )
    other = next(c for c in fv.CODECS if c != codec)
    found_codec = F.when(F.col("rank") % 2 == 0, F.lit(codec)).otherwise(F.lit(other))
    found_encrypted = F.when(F.col("rank") < 2, F.lit(encrypted)).otherwise(F.lit(not encrypted))
    return (
        wanted.join(best, "key_base", "left")
        .withColumn("found_key", F.when(F.col("rank").isNotNull(), full_key(F.col("key_base"), found_codec, found_encrypted)))
        .withColumn("found_codec", F.when(F.col("rank").isNotNull(), found_codec))
        .withColumn("found_encrypted", F.when(F.col("rank").isNotNull(), found_encrypted))
        .withColumnRenamed("size", "found_size")
        .drop("rank", "key_base")
    )


def validation_route(
    snapshots: DataFrame, objects: DataFrame, bucket: str, codec: str, encrypted: bool
) -> DataFrame:
    """What to validate each snapshot against: its image if stored, else archives.

    ``snapshots`` has an array ``partitions``. One row per image, or per
    partition without an image; ``route`` is image, archive or missing, and
    ``place`` the partition's place in the array (-1 for an image). A missing
    archive has its ``expected_key``, in the configured codec and encryption.
    Images and archives are looked up together, so the listing is read and
    moved once.
    """
    found = ["found_key", "found_size", "found_encrypted"]
    parts = F.transform("partitions", lambda name, place: F.struct(place.alias("place"), name.alias("partition_name")))
    image = F.array(F.struct(F.lit(-1).alias("place"), F.lit("").alias("partition_name")))
    wanted = snapshots.select(
        "snapshot_id", "volume_id", "start_time", "description", F.inline(F.concat(image, F.coalesce(parts, F.array())))
    )
    is_image = F.col("place") < 0
    base = F.when(is_image, image_base(*_identity())).otherwise(archive_base(*_identity(), F.col("partition_name")))
    keyed = wanted.withColumns({"key_base": base, "expected_key": full_key(base, F.lit(codec), F.lit(encrypted))})
    looked_up = durable(
        find_objects(keyed, objects, bucket, codec, encrypted).select(
            "snapshot_id", "partition_name", "place", "expected_key", *found
        )
    )
    stored = F.col("found_key").isNotNull()
    by_image = looked_up.where(is_image & stored).withColumn("route", F.lit("image"))
    by_archive = (
        looked_up.where(~is_image)
        .join(by_image.select("snapshot_id"), "snapshot_id", "left_anti")
        .withColumn("route", F.when(stored, F.lit("archive")).otherwise(F.lit("missing")))
    )
    return by_image.unionByName(by_archive).select(
        "snapshot_id",
        "partition_name",
        "place",
        "route",
        *found,
        F.when(F.col("route") == "missing", F.col("expected_key")).alias("expected_key"),
    )


def missing_message(bucket: str) -> Column:
    """What is said of a route without a stored object; null for the others."""
    return F.when(F.col("route") == "missing", F.format_string(fv.OBJECT_MISSING, F.lit(bucket), F.col("expected_key")))


# --- volumes ------------------------------------------------------------------
def reusable_volumes(
    snapshots: DataFrame, volumes: DataFrame, tag: str, zone: str, instance_id: str
) -> DataFrame:
    """For each snapshot the first tagged volume in our zone free for our use.

    Volumes are combined per snapshot before the join.
    """
    # A volume without attachments is free.
    free = F.coalesce(F.forall(F.col("attachments"), lambda a: a["InstanceId"] == instance_id), F.lit(True))
    first = (
        volumes.where(has_tag(F.col("tags"), tag) & (F.col("availability_zone") == zone) & free)
        .groupBy("snapshot_id")
        .agg(F.min("volume_id").alias("reusable_volume_id"))
    )
    return snapshots.select("snapshot_id").join(first, "snapshot_id")


def volume_type(size_gb: Column, requested: Column | None = None) -> Column:
    """Type of a temporary volume; ``auto`` picks one by size."""
    automatic = F.when(size_gb > fv.STANDARD_VOLUME_LIMIT_GB, F.lit(fv.VOLUME_LARGE)).otherwise(
        F.lit(fv.VOLUME_STANDARD)
    )
    if requested is None:
        return automatic
    return F.when(requested == "auto", automatic).otherwise(requested)


# --- metadata and states ------------------------------------------------------
def object_metadata(uncompressed_size: Column | None = None) -> Column:
    """Metadata map stored with a snapshot's object."""
    entries = [
        (fv.METADATA_STARTTIME, utc_iso(F.col("start_time"))),
        (fv.METADATA_SNAPSHOTID, F.col("snapshot_id")),
        (fv.METADATA_VOLUMESIZE, F.col("volume_size").cast("string")),
        (fv.METADATA_VOLUMEID, F.col("volume_id")),
        (fv.METADATA_DESCRIPTION, F.col("description")),
    ]
    if uncompressed_size is not None:
        entries.append((fv.METADATA_SIZE, uncompressed_size.cast("string")))
    return F.create_map(*[part for name, value in entries for part in (F.lit(name), value)])


def next_state(mode: Column, ok: Column, inline_validate: Column, prior: Column) -> Column:
    """State tag after a migration or validation attempt."""
    after_migrate = (
        F.when(ok & inline_validate, F.lit(fv.STATE_VALIDATED))
        .when(ok, F.lit(fv.STATE_MIGRATED))
        .otherwise(F.lit(fv.STATE_MIGRATE))
    )
    after_validate = (
        F.when(ok, F.lit(fv.STATE_VALIDATED))
        .when(prior.isin(fv.STATE_VALIDATED, fv.STATE_VALIDATING), F.lit(fv.STATE_MIGRATED))
        .otherwise(F.coalesce(prior, F.lit("")))
    )
    return F.when(mode == "migrate", after_migrate).when(mode == "validate", after_validate)


# --- outcomes -----------------------------------------------------------------
def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """Successes and failures per mode."""
    return outcomes.groupBy("mode").agg(
        F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed")
    )


def outcome_report(outcomes: DataFrame) -> DataFrame:
    """Validated ids, then failed ids with their messages, as numbered lines.

    The section of an empty list is left out. One line per id, so no list of ids
    has to fit into one row.
    """
    ok = F.col("ok")
    validated = outcomes.where(F.col("mode") == "validate")
    lines = validated.select(
        F.when(ok, 0).otherwise(1).alias("section"),
        F.lit(1).alias("part"),
        "snapshot_id",
        F.when(ok, F.col("snapshot_id")).otherwise(F.concat_ws(": ", "snapshot_id", "message")).alias("line"),
    )
    headers = (
        validated.groupBy(F.when(ok, 0).otherwise(1).alias("section"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .select(
            "section",
            F.lit(0).alias("part"),
            F.lit("").alias("snapshot_id"),
            F.when(F.col("section") == 0, F.lit(fv.SUCCESS_HEADER)).otherwise(F.lit(fv.FAILURE_HEADER)).alias("line"),
        )
    )
    return with_positions(
        headers.unionByName(lines), [F.col("section").asc(), F.col("part").asc(), F.col("snapshot_id").asc(), F.col("line").asc()]
    ).select("position", "line")


# --- uploads ------------------------------------------------------------------
def upload_plan(jobs: DataFrame) -> DataFrame:
    """Codec check, level, part size, parts, memory and request cost of uploads.

    ``jobs`` has ``uncompressed_bytes, codec, level, streams``.
    """
    part = F.greatest(
        F.ceil((F.col("uncompressed_bytes") + fv.PART_HEADROOM_BYTES) / F.lit(fv.USABLE_PARTS)),
        F.lit(fv.MIN_PART_BYTES),
    ).cast("bigint")
    # Half-way values round up, also below zero.
    nearest = lambda c: F.floor(c + F.lit(0.5))
    return (
        jobs.withColumn("codec_ok", F.col("codec").isin(*fv.CODECS))
        .withColumn("level", F.least(F.greatest(nearest(F.col("level")), F.lit(fv.LEVEL_MIN)), F.lit(fv.LEVEL_MAX)).cast("bigint"))
        .withColumn("streams", F.greatest(nearest(F.col("streams")), F.lit(1)).cast("bigint"))
        .withColumn("part_bytes", part)
        .withColumn("parts", F.ceil(F.col("uncompressed_bytes") / F.col("part_bytes")))
        .withColumn("memory_bytes", F.col("part_bytes") * F.col("streams"))
        .withColumn("request_cost", F.col("parts") * fv.PUT_PRICE)
    )


def sanitised_tag_rows(tags: DataFrame, own_tag: str) -> DataFrame:
    """``sanitise_tags`` for tags held one per row (``Key, Value``)."""
    key = F.col("Key")
    kept = ~key.isin(own_tag, own_tag + "-id") & ~key.startswith(fv.RESERVED_TAG_PREFIX)
    return tags.where(kept).withColumn("Key", legal_text(key)).withColumn("Value", legal_text(F.col("Value")))
