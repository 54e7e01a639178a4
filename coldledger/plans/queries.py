"""The registered queries: every operator on inputs derived from whole tables."""

from __future__ import annotations

import hashlib
import os
import tarfile
import uuid
from collections.abc import Callable, Iterator
from io import BytesIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.paths import strip_directory, strip_root
from ..functions.tags import volume_name
from ..functions.text import parse_float_lenient, significant
from ..operators import catalogue, costs, manifests, tiers, usage, validation
from ..session import durable, mounted_path, new_folder, ship_package
from ..sources import archives, directories, manifest_files, usage_csv
from . import bindings as b
from . import workflows

Query = Callable[[SparkSession, str], DataFrame]


def _six(column: str) -> Column:
    """Doubles are compared at six decimals."""
    return F.round(column, 6).alias(column)


# --- usage report ---------------------------------------------------------------
def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.parse_usage(b.usage_report(spark, sf_dir))


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per resource, written out: the report itself is scanned once."""
    return durable(usage.latest_usage(_usage(spark, sf_dir)))


def _chain(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Latest usage, described snapshots and volume rollup, each written out."""
    return workflows.cost_tables(b.usage_report(spark, sf_dir), b.snapshots(spark, sf_dir), b.volumes(spark, sf_dir))


def _rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = costs.with_snapshots(_latest(spark, sf_dir), b.snapshots(spark, sf_dir))
    return costs.volume_rollup(described, b.volumes(spark, sf_dir))


def usage_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _usage(spark, sf_dir)


def usage_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.rejected_usage(b.usage_report(spark, sf_dir))


def usage_region_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = usage.in_regions(_usage(spark, sf_dir), ["africa", "middle-east"])
    return kept.select("seq", "region", "snapshot_id", "usage_amount")


def parse_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value").cast("string")
    text = (
        F.when(kind == "click", F.concat(value, F.lit("GB")))
        .when(kind == "error", F.concat(F.lit("  -"), value))
        .when(kind == "signup", F.col("props"))
        .when(kind == "purchase", F.concat(value, F.lit("e2x")))
        .otherwise(F.concat(F.lit("."), F.get_json_object("props", "$.k")))
    )
    events = b.table(spark, sf_dir, "events").select("event_id", text.alias("amount_text"))
    number = parse_float_lenient(F.col("amount_text"))
    return events.select(
        "event_id", "amount_text", F.isnan(number).alias("is_nan"), F.nanvl(number, F.lit(0.0)).alias("number")
    )


def monthly_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    monthly = usage.monthly_usage(F.col("usage_amount"), F.col("interval_seconds"))
    return _usage(spark, sf_dir).select("seq", "interval_seconds", F.round(monthly, 6).alias("monthly_gb"))


def usage_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.latest_usage(_usage(spark, sf_dir))


def region_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.region_latest(_usage(spark, sf_dir))


def distinct_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.distinct_owners(_usage(spark, sf_dir))


def usage_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.current_usage(_latest(spark, sf_dir)).select(
        "resource_id", "region", "start_seconds", "usage_amount", _six("monthly_gb"), _six("monthly_cost")
    )


# --- costs ----------------------------------------------------------------------
def usage_with_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = costs.with_snapshots(_latest(spark, sf_dir), b.snapshots(spark, sf_dir))
    return described.select("region", "snapshot_id", "volume_id", "volume_size", "description", _six("monthly_gb"))


def usage_with_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, described, rollup = _chain(spark, sf_dir)
    return costs.with_volumes(described, rollup).select(
        "region", "snapshot_id", "volume_id", "size", "deleted", "volume_name", _six("monthly_gb")
    )


def volume_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rollup(spark, sf_dir).select(
        "region", "volume_id", "size", "deleted", "volume_name", "snapshots", _six("monthly_gb"), _six("monthly_cost")
    )


def region_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest, _, rollup = _chain(spark, sf_dir)
    return costs.region_rollup(latest, rollup).select("region", "region_seq", _six("monthly_cost"), "snapshots")


def volume_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rollup(spark, sf_dir).select(
        "region", "volume_id", "snapshots", _six("first_gb"), _six("avg_change_pct")
    )


def snapshot_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, described, rollup = _chain(spark, sf_dir)
    return costs.snapshot_changes(costs.with_volumes(described, rollup)).select(
        "region", "volume_id", "snapshot_id", "is_first", _six("monthly_gb"), _six("change_pct")
    )


def volumes_by_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, rollup = _chain(spark, sf_dir)
    return costs.volumes_by_cost(rollup).select("region", "cost_rank", "volume_id", _six("monthly_cost"))


def cost_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return costs.report_lines(*_chain(spark, sf_dir))


def sig_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("value")
    return b.table(spark, sf_dir, "events").select(
        "event_id",
        significant(value / 7.0, 2).alias("two_digits"),
        significant(value * 100.0 / 3.0, 3).alias("three_digits"),
        significant(value / 1000.0, 3).alias("three_digits_small"),
    )


# --- tiers ----------------------------------------------------------------------
def _tier_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    change = F.coalesce("avg_change_pct", F.lit(0.0)) / 100
    return tiers.per_tier(_rollup(spark, sf_dir).withColumn("change", change)).select(
        "region", "volume_id", "snapshots", "change", "tier", "price"
    )


def tier_cost_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = lambda c: tiers.tier_cost_ratio(F.col("price"), F.col("snapshots"), F.col("change"), F.lit(c))
    return _tier_options(spark, sf_dir).select(
        "region",
        "volume_id",
        "tier",
        F.round(ratio(1.0) * 100, 6).alias("plain_pct"),
        F.round(ratio(0.5) * 100, 6).alias("compressed_pct"),
    )


def tier_break_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = tiers.break_even_change(F.col("price"), F.lit(1.0))
    half = tiers.break_even_change(F.col("price"), F.lit(0.5))
    return _tier_options(spark, sf_dir).select(
        "region",
        "volume_id",
        "tier",
        F.round(point * 100, 6).alias("break_even_pct"),
        F.round(half * 100, 6).alias("compressed_break_even_pct"),
        (F.col("change") > point).alias("cheaper_in_the_limit"),
    )


def migration_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiers.migration_candidates(_rollup(spark, sf_dir)).select(
        "region",
        "volume_id",
        "size",
        "snapshots",
        _six("monthly_cost"),
        _six("cost_ratio"),
        "best_tier",
        "warmest_tier",
        _six("monthly_saving"),
    )


def min_billed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = F.date_diff(F.col("last_time").cast("date"), F.col("start_time").cast("date")).cast("bigint")
    dated = b.snapshots(spark, sf_dir).select("region", "snapshot_id", stored.alias("stored_days"))
    return tiers.per_tier(dated).select(
        "region",
        "snapshot_id",
        "tier",
        "stored_days",
        tiers.billed_days(F.col("stored_days"), F.col("min_days")).alias("billed_days"),
    )


def transfer_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.sum("volume_size") * F.lit(2**30)
    hours = lambda workers: F.round(tiers.transfer_seconds(F.col("total_bytes"), F.lit(workers)) / 3600, 6)
    return (
        b.snapshots(spark, sf_dir)
        .groupBy("region")
        .agg(total.alias("total_bytes"))
        .select("region", "total_bytes", hours(1).alias("hours"), hours(9).alias("hours_by_nine"))
    )


# --- manifests ------------------------------------------------------------------
def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both manifests are written out first, so every text is read and hashed once."""
    left, right = durable(b.manifest_left(spark, sf_dir)), durable(b.manifest_right(spark, sf_dir))
    return manifests.compare_manifests(left, right)


def path_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    lang = F.col("lang")
    relative = F.concat_ws("/", "source", "doc_id")
    lead = F.when(lang == "en", "./").when(lang == "de", "/").when(lang == "fr", ".//").otherwise("")
    below = strip_directory(F.concat(F.lit("/mnt/vol/"), relative).cast("binary"), b"/mnt/vol")
    return b.table(spark, sf_dir, "documents").select(
        "doc_id",
        below.cast("string").alias("below_directory"),
        strip_root(F.concat(lead, relative).cast("binary")).cast("string").alias("below_root"),
    )


def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir).select(
        F.col("filename").cast("string").alias("filename"),
        "copy",
        "status",
        "left_hash",
        "right_hash",
        manifests.difference_message(b.LEFT_NAME, b.RIGHT_NAME).alias("message"),
    )


def manifest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.difference_report(durable(_compared(spark, sf_dir)), b.LEFT_NAME, b.RIGHT_NAME)


def manifest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.summarise_comparison(_compared(spark, sf_dir))


def manifest_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = manifests.sort_manifest(b.manifest_left(spark, sf_dir))
    return ordered.withColumn("filename", F.col("filename").cast("string"))


def manifest_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = b.table(spark, sf_dir, "documents").select(F.octet_length("text").cast("bigint").alias("size"))
    pages = b.table(spark, sf_dir, "pages").select(F.octet_length("html").cast("bigint").alias("size"))
    return manifests.manifest_size(documents.unionByName(pages))


def content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digests(name: str, key: str, content: str) -> DataFrame:
        hash_ = manifests.content_digest(F.col(content).cast("binary"))
        return b.table(spark, sf_dir, name).select(F.lit(name).alias("kind"), F.col(key).alias("id"), hash_.alias("hash"))

    return digests("documents", "doc_id", "text").unionByName(digests("pages", "page_id", "html"))


def digest_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.compare_digests(*b.digests(spark, sf_dir), "doc_id")


def hardlink_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = manifests.resolve_hard_links(durable(b.members(spark, sf_dir)))
    return resolved.withColumn("filename", F.col("filename").cast("string"))


def manifest_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The left manifest, written as a manifest file and read back."""
    path = new_folder(spark, "manifest")
    manifest_files.write_manifest(b.manifest_left(spark, sf_dir), path)
    return manifest_files.read_manifest(spark, path).withColumn("filename", F.col("filename").cast("string"))


# --- files ----------------------------------------------------------------------
def cur_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usage report, written as compressed CSV and read back."""
    path = new_folder(spark, "usage")
    usage_csv.write_usage_report(b.usage_report(spark, sf_dir), path)
    return usage_csv.read_usage_report(spark, path).select(
        *[F.col(f"`{name}`").alias(name.split("/")[1]) for name in fv.USAGE_COLUMNS]
    )


def _file_writer(root: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source, doc_id, text in zip(batch["source"], batch["doc_id"], batch["text"]):
                folder = os.path.join(root, source)
                os.makedirs(folder, exist_ok=True)
                # A retried task replaces whole files only.
                final = os.path.join(folder, f".{doc_id}.txt")
                with open(f"{root}.{uuid.uuid4().hex}.part", "wb") as out:
                    out.write(text.encode("utf-8"))
                os.replace(out.name, final)
            yield pd.DataFrame({"files": [len(batch)]})

    return write


def dir_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as hidden files, one folder per source, and hashed there."""
    ship_package(spark)
    root = mounted_path(new_folder(spark, "tree"))
    os.makedirs(root)
    documents = b.table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    documents.mapInPandas(_file_writer(root), "files bigint").agg(F.sum("files")).collect()
    hashed = directories.hash_directory(spark, root)
    return hashed.withColumn("filename", F.col("filename").cast("string"))


def _linked_writer(root: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Equal texts are names of one file, where their ids have the same rest by 16: a file system has a limit of names."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source, doc_id, text in zip(batch["source"], batch["doc_id"], batch["text"]):
                folder = os.path.join(root, source)
                os.makedirs(folder, exist_ok=True)
                first = os.path.join(root, f"{hashlib.md5(text.encode('utf-8')).hexdigest()}-{doc_id % 16}")
                if not os.path.exists(first):
                    with open(f"{root}.{uuid.uuid4().hex}.part", "wb") as out:
                        out.write(text.encode("utf-8"))
                    os.replace(out.name, first)
                name = os.path.join(folder, str(doc_id))
                if not os.path.exists(name):
                    os.link(first, name)
            yield pd.DataFrame({"files": [len(batch)]})

    return write


def directory_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as files, equal texts as names of one file: its bytes count once."""
    ship_package(spark)
    root = mounted_path(new_folder(spark, "linked"))
    os.makedirs(root)
    # The names of one file meet in one task, which alone makes it.
    documents = b.table(spark, sf_dir, "documents").where("text IS NOT NULL").select("source", "doc_id", "text")
    documents = documents.repartition(F.md5("text"), F.col("doc_id") % 16)
    documents.mapInPandas(_linked_writer(root), "files bigint").agg(F.sum("files")).collect()
    return directories.directory_size(spark, root).select("file_bytes", "files")


def _archive_writer(root: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def add(tar: tarfile.TarFile, name: str, text: bytes = b"", target: str | None = None) -> None:
        member = tarfile.TarInfo(name)
        if target is None:
            member.size = len(text)
        else:
            member.type, member.linkname = tarfile.LNKTYPE, target
        tar.addfile(member, BytesIO(text))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tar = path = None
        for batch in batches:
            for part, doc_id, lang, text in zip(batch["part"], batch["doc_id"], batch["lang"], batch["text"]):
                if tar is None:
                    path = os.path.join(root, f"part-{part}.tar" + (".gz" if part % 2 else ""))
                    tar = tarfile.open(f"{root}.{uuid.uuid4().hex}.part", "w:gz" if part % 2 else "w")
                add(tar, f"./{doc_id}", text.encode("utf-8"))
                if lang == "es":
                    add(tar, f"links/{doc_id}", target=f"/{doc_id}")
        if tar is not None:
            tar.close()
            # A retried task replaces a whole archive only.
            os.replace(tar.name, path)
            yield pd.DataFrame({"archive": [path]})

    return write


def archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into plain and gzip archives, one per task, and hashed there."""
    ship_package(spark)
    root = mounted_path(new_folder(spark, "archives"))
    os.makedirs(root)
    documents = b.table(spark, sf_dir, "documents").repartition(directories.task_count(spark), "doc_id")
    packed = durable(
        documents.select("doc_id", "lang", "text", F.spark_partition_id().alias("part")).mapInPandas(
            _archive_writer(root), "archive string"
        )
    )
    found = durable(archives.read_archives(spark, packed))
    manifest = manifests.require_resolved(manifests.resolve_hard_links(found))
    return manifest.select(F.col("filename").cast("string").alias("filename"), "hash")


# --- catalogue ------------------------------------------------------------------
def _queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshots = b.snapshots(spark, sf_dir)
    queue = lambda state: catalogue.work_queue(snapshots, b.TAG, state, b.OWNER)
    to_migrate = queue(fv.STATE_MIGRATE).withColumn("queue", F.lit(fv.STATE_MIGRATE))
    return to_migrate.unionByName(queue(fv.STATE_MIGRATED).withColumn("queue", F.lit(fv.STATE_MIGRATED)))


def work_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queues(spark, sf_dir).select("queue", "region", "snapshot_id", "volume_id")


def work_queue_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = catalogue.work_queue(b.snapshots(spark, sf_dir), b.TAG, fv.STATE_MIGRATE, b.OWNER)
    return catalogue.next_in_queue(queue).select("region", "snapshot_id", "volume_id")


def missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.missing_snapshots(b.requested_ids(spark, sf_dir), b.snapshots(spark, sf_dir))


def requested_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalogue.requested_snapshots(b.requested_ids(spark, sf_dir), b.snapshots(spark, sf_dir))
    return found.select("region", "snapshot_id", "volume_id", "status")


def object_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.objects(spark, sf_dir)


def object_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = catalogue.with_archive_key(
        b.snapshots(spark, sf_dir).withColumn("partition_name", F.explode("partitions"))
    )
    found = catalogue.find_objects(wanted, b.objects(spark, sf_dir), b.BUCKET, "zstd", False)
    return found.select("snapshot_id", "partition_name", "found_key", "found_codec", "found_encrypted", "found_size")


def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.validation_route(
        b.snapshots(spark, sf_dir), b.objects(spark, sf_dir), b.BUCKET, "lz4", False
    )


def validation_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routes(spark, sf_dir).drop("place", "expected_key")


def missing_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = _routes(spark, sf_dir).where(F.col("route") == "missing")
    message = catalogue.missing_message(b.BUCKET).alias("message")
    return missing.select("snapshot_id", "partition_name", "expected_key", message)


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    routes = durable(_routes(spark, sf_dir))
    compared = validation.compare_archives(routes, b.local_files(spark, sf_dir), b.stored_files(spark, sf_dir))
    images = b.local_images(spark, sf_dir), b.stored_images(spark, sf_dir)
    return durable(validation.partition_checks(routes, compared, *images, b.BUCKET))


def partition_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checks(spark, sf_dir).select("snapshot_id", "partition_name", "route", "ok", "files", "differences", "message")


def validation_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.validation_outcomes(b.snapshots(spark, sf_dir), _checks(spark, sf_dir), b.TAG)


def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = validation.validation_outcomes(b.snapshots(spark, sf_dir), _checks(spark, sf_dir), b.TAG)
    return catalogue.outcome_report(durable(outcomes))


def object_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = catalogue.object_metadata(F.col("stored_bytes"))
    return b.snapshots(spark, sf_dir).select("region", "snapshot_id", F.explode(entries).alias("name", "value"))


def sanitise_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.sanitised_tag_rows(b.tag_texts(spark, sf_dir), b.TAG).select(
        "conv_id", "turn", F.col("Key").alias("tag_key"), F.col("Value").alias("tag_value")
    )


def snapshot_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.tags import sanitise_tags as clean

    return (
        b.snapshots(spark, sf_dir)
        .select("snapshot_id", F.inline(clean(F.col("tags"), b.TAG)))
        .select("snapshot_id", F.col("Key").alias("tag_key"), F.col("Value").alias("tag_value"))
    )


def name_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.volumes(spark, sf_dir).select("region", "volume_id", volume_name(F.col("tags")).alias("volume_name"))


def volume_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.round(F.col("p_retailprice") + F.col("p_size") * 5).cast("bigint")
    requested = F.when(F.col("p_type") == "PROMO", "io1").otherwise("auto")
    return (
        b.table(spark, sf_dir, "part")
        .select("p_partkey", size.alias("size_gb"), requested.alias("requested"))
        .withColumn("volume_type", catalogue.volume_type(F.col("size_gb"), F.col("requested")))
    )


def upload_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.upload_plan(b.upload_jobs(spark, sf_dir)).withColumn(
        "request_cost", F.round("request_cost", 9)
    )


def status_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = catalogue.next_state(F.col("mode"), F.col("ok"), F.col("inline_validate"), F.col("prior_tag"))
    return b.outcomes(spark, sf_dir).select("snapshot_id", "mode", "ok", "prior_tag", state.alias("new_tag"))


def reusable_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.reusable_volumes(
        b.snapshots(spark, sf_dir), b.restored_volumes(spark, sf_dir), b.TAG, b.ZONE, b.INSTANCE
    )


def outcome_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.outcome_counts(b.outcomes(spark, sf_dir))


def outcome_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.outcome_report(b.outcomes(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "usage_parse": usage_parse,
    "usage_rejects": usage_rejects,
    "usage_region_filter": usage_region_filter,
    "parse_float_lenient": parse_float,
    "monthly_usage": monthly_usage,
    "usage_latest": usage_latest,
    "region_latest": region_latest,
    "distinct_owners": distinct_owners,
    "usage_current": usage_current,
    "usage_with_snapshot": usage_with_snapshot,
    "usage_with_volume": usage_with_volume,
    "volume_rollup": volume_rollup,
    "region_rollup": region_rollup,
    "volume_change": volume_change,
    "snapshot_ranked": snapshot_ranked,
    "volumes_by_cost": volumes_by_cost,
    "cost_report_lines": cost_report_lines,
    "sig_digits": sig_digits,
    "tier_cost_ratio": tier_cost_ratio,
    "tier_break_even": tier_break_even,
    "migration_candidates": migration_candidates,
    "min_billed_days": min_billed_days,
    "transfer_eta": transfer_eta,
    "path_normalise": path_normalise,
    "manifest_diff": manifest_diff,
    "manifest_report": manifest_report,
    "manifest_summary": manifest_summary,
    "manifest_sorted": manifest_sorted,
    "manifest_size": manifest_size,
    "content_digest": content_digest,
    "digest_compare": digest_compare,
    "hardlink_resolve": hardlink_resolve,
    "manifest_roundtrip": manifest_roundtrip,
    "cur_scan": cur_scan,
    "dir_manifest": dir_manifest,
    "directory_size": directory_size,
    "archive_members": archive_members,
    "work_queue": work_queue,
    "work_queue_one": work_queue_one,
    "missing_ids": missing_ids,
    "requested_snapshots": requested_snapshots,
    "object_keys": object_keys,
    "object_lookup": object_lookup,
    "validation_route": validation_route,
    "missing_objects": missing_objects,
    "partition_checks": partition_checks,
    "validation_outcomes": validation_outcomes,
    "validation_report": validation_report,
    "object_metadata": object_metadata,
    "sanitise_tags": sanitise_tags,
    "snapshot_tags": snapshot_tags,
    "name_tag": name_tag,
    "volume_type": volume_type,
    "upload_plan": upload_plan,
    "status_transition": status_transition,
    "reusable_volumes": reusable_volumes,
    "outcome_rollup": outcome_rollup,
    "outcome_report": outcome_report,
}
