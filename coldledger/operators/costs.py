"""Cost of snapshot chains by snapshot, volume and region, and the cost report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.ordering import order_key
from ..functions.tags import volume_name
from ..functions.text import fixed, plural, round_half_up, significant, utc_date, utc_seconds
from ..session import durable
from .skew import PART_ROWS, join_spread, semi_join_spread, with_positions, with_rows
from .usage import current_usage, distinct_owners, region_latest

VOLUME_KEYS = ["region", "volume_id"]


def with_snapshots(latest: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Current usage joined with completed snapshots of the owners in the report.

    Billed snapshots without a description are taken to be deleted and left out.
    Both sides of the join have one row per key.
    """
    completed = snapshots.where(F.col("status") == fv.STATUS_COMPLETED)
    owners = with_rows(distinct_owners(latest), completed, ["owner_id"])
    described = semi_join_spread(completed, owners, ["owner_id"], "snapshot_id").select("region", "snapshot_id", "volume_id", "volume_size", "start_time", "description")
    return current_usage(latest).join(described, ["region", "snapshot_id"])


def _by_date() -> Column:
    return order_key(utc_seconds(F.col("start_time")), F.col("seq"))


def volume_rollup(described: DataFrame, volumes: DataFrame) -> DataFrame:
    """One row per billed volume: usage, cost, count and change between snapshots.

    Aggregated before the join, so a volume with very many snapshots is combined
    map-side and the join meets one row per volume on either side. A volume that
    is no longer described gets the size its first seen snapshot reports.
    """
    chains = described.groupBy(*VOLUME_KEYS).agg(
        F.count(F.lit(1)).alias("snapshots"),
        F.sum("monthly_gb").alias("monthly_gb"),
        F.sum("monthly_cost").alias("monthly_cost"),
        F.min("seq").alias("volume_seq"),
        F.min_by("volume_size", "seq").alias("_first_seen_size"),
        F.min(_by_date()).alias("first_key"),
        F.min_by("monthly_gb", _by_date()).alias("first_gb"),
    )
    known = volumes.select(
        *VOLUME_KEYS, F.col("size").alias("_size"), volume_name(F.col("tags")).alias("_name"), F.lit(True).alias("_known")
    )
    size = F.coalesce(F.col("_size"), F.col("_first_seen_size"))
    change = (F.col("monthly_gb") - F.col("first_gb")) / F.col("snapshots") / F.nullif(F.col("size"), F.lit(0)) * 100
    return (
        chains.join(known, VOLUME_KEYS, "left")
        .withColumn("size", size)
        .withColumn("deleted", F.col("_known").isNull())
        .withColumn("volume_name", F.coalesce(F.col("_name"), F.lit("")))
        .withColumn("avg_change_pct", F.when(F.col("snapshots") > 1, change))
        .drop("_size", "_name", "_known", "_first_seen_size")
    )


def with_volumes(described: DataFrame, rollup: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Every current snapshot with its volume's attributes.

    ``described`` and ``rollup`` should be ``durable``: both are read twice.
    """
    attributes = rollup.select(*VOLUME_KEYS, "size", "deleted", "volume_name", "first_key", "volume_seq")
    counts = rollup.select(*VOLUME_KEYS, F.col("snapshots").alias("rows"))
    return join_spread(described, attributes, VOLUME_KEYS, counts, "resource_id", part_rows)


def snapshot_changes(placed: DataFrame) -> DataFrame:
    """Mark each volume's first snapshot by date; give the others their change.

    The first one is found by the rollup's minimum key, so no window has to
    bring a volume's snapshots together.
    """
    first = _by_date() == F.col("first_key")
    return placed.withColumn("is_first", first).withColumn(
        "change_pct", F.when(~first, F.col("monthly_gb") / F.nullif(F.col("size"), F.lit(0)) * 100)
    )


def region_rollup(latest: DataFrame, rollup: DataFrame) -> DataFrame:
    """Cost and snapshot count per region of the report, in first-seen order keys.

    A region all of whose snapshots dropped out is kept with zeros.
    """
    sums = rollup.groupBy("region").agg(
        F.sum("monthly_cost").alias("monthly_cost"), F.sum("snapshots").alias("snapshots")
    )
    return (
        region_latest(latest)
        .join(sums, "region", "left")
        .select(
            "region",
            "region_seq",
            F.coalesce("monthly_cost", F.lit(0.0)).alias("monthly_cost"),
            F.coalesce("snapshots", F.lit(0)).alias("snapshots"),
        )
    )


def _cost_rank(cost: Column) -> Column:
    """Cost as a sort key, free of summation noise; NaN keeps its place."""
    return F.round(cost, 9).desc()


def volumes_by_cost(rollup: DataFrame) -> DataFrame:
    """Volumes numbered within their region from the most expensive down.

    Equal costs keep the order in which the volumes were first seen. Numbered by
    a global sort, so a region that holds most volumes is spread over tasks; the
    first position of each region turns global numbers into numbers within it.
    """
    numbered = with_positions(
        rollup,
        [F.col("region").asc(), _cost_rank(F.col("monthly_cost")), F.col("volume_seq").asc(), F.col("volume_id").asc()],
        "_position",
    )
    starts = numbered.groupBy("region").agg(F.min("_position").alias("_start"))
    counts = rollup.groupBy("region").agg(F.count(F.lit(1)).alias("rows"))
    return (
        join_spread(numbered, starts, ["region"], counts, "volume_id")
        .withColumn("cost_rank", F.col("_position") - F.col("_start") + 1)
        .drop("_position", "_start")
    )


def _region_lines(regions: DataFrame, section: int, text: Column) -> DataFrame:
    return regions.select(
        "region_seq",
        F.lit(section).alias("section"),
        F.lit(None).cast("double").alias("volume_cost"),
        F.lit(None).cast("bigint").alias("volume_seq"),
        F.lit(None).cast("string").alias("volume_id"),
        F.lit(0).alias("part"),
        F.lit(None).cast("decimal(38,0)").alias("snapshot_key"),
        F.lit(None).cast("string").alias("resource_id"),
        text.alias("line"),
    )


def _volume_lines(
    volumes: DataFrame, part: int, text: Column, snapshot_key: Column | None = None, resource: Column | None = None
) -> DataFrame:
    return volumes.select(
        "region_seq",
        F.lit(1).alias("section"),
        F.round("volume_cost", 9).alias("volume_cost"),
        "volume_seq",
        "volume_id",
        F.lit(part).alias("part"),
        (F.lit(None) if snapshot_key is None else snapshot_key).cast("decimal(38,0)").alias("snapshot_key"),
        (F.lit(None) if resource is None else resource).cast("string").alias("resource_id"),
        text.alias("line"),
    )


def _region_text() -> Column:
    count = F.col("snapshots")
    return F.format_string(fv.REGION_LINE, F.col("region"), fixed(F.col("monthly_cost"), 2), count, plural(count))


def _volume_text() -> Column:
    count = F.col("snapshots")
    label = (
        F.when(F.col("deleted"), F.lit(fv.DELETED_LABEL))
        .when(F.length("volume_name") > 0, F.concat(F.lit(", "), F.col("volume_name")))
        .otherwise(F.lit(""))
    )
    line = F.format_string(
        fv.VOLUME_LINE,
        F.col("volume_id"),
        F.col("size"),
        label,
        round_half_up(F.col("monthly_gb")),
        significant(F.col("monthly_cost"), 3),
        count,
        plural(count),
    )
    change = F.format_string(fv.VOLUME_CHANGE, significant(F.col("avg_change_pct"), 2))
    return F.concat(line, F.when(count > 1, change).otherwise(F.lit("")))


def _snapshot_text() -> Column:
    line = F.format_string(
        fv.SNAPSHOT_LINE, F.col("snapshot_id"), utc_date(F.col("start_time")), fixed(F.col("monthly_gb"), 1, 4)
    )
    change = F.format_string(fv.SNAPSHOT_CHANGE, significant(F.col("change_pct"), 2))
    return F.concat(line, F.when(~F.col("is_first"), change).otherwise(F.lit("")))


def report_lines(latest: DataFrame, described: DataFrame, rollup: DataFrame) -> DataFrame:
    """The cost report as numbered text lines.

    All three inputs should be ``durable``. Every line carries the sort keys of
    its place; one global sort puts the lines in order.
    """
    regions = region_rollup(latest, rollup)
    volumes_per_region = rollup.groupBy("region").agg(F.count(F.lit(1)).alias("rows"))
    volumes = durable(
        join_spread(rollup, regions.select("region", "region_seq"), ["region"], volumes_per_region, "volume_id")
        .withColumn("volume_text", _volume_text())
        .withColumnRenamed("monthly_cost", "volume_cost")
    )
    attributes = volumes.select(*VOLUME_KEYS, "region_seq", "volume_cost", "volume_seq", "size", "first_key")
    counts = rollup.select(*VOLUME_KEYS, F.col("snapshots").alias("rows"))
    snapshots = snapshot_changes(join_spread(described, attributes, VOLUME_KEYS, counts, "resource_id"))
    blank = F.lit("")
    parts = [
        _region_lines(regions, 0, _region_text()),
        _volume_lines(volumes, 1, F.col("volume_text")),
        _volume_lines(snapshots, 2, _snapshot_text(), _by_date(), F.col("resource_id")),
        _volume_lines(volumes, 3, blank),
        _region_lines(regions, 2, blank),
    ]
    lines = parts[0]
    for part in parts[1:]:
        lines = lines.unionByName(part)
    order = [
        F.col("region_seq").asc(),
        F.col("section").asc(),
        F.col("volume_cost").desc(),
        F.col("volume_seq").asc(),
        F.col("volume_id").asc(),
        F.col("part").asc(),
        F.col("snapshot_key").asc(),
        F.col("resource_id").asc(),
    ]
    return with_positions(lines, order).select("position", "line")
