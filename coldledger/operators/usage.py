"""Usage report lines: parsing, and the latest usage of each billed resource."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.ordering import order_key
from ..functions.text import epoch_seconds, interval_bounds, is_interval, parse_float_lenient
from .skew import semi_join_spread, with_rows


def _snapshot_lines(report: DataFrame) -> DataFrame:
    resource = F.col(f"`{fv.COL_RESOURCE}`")
    interval = F.col(f"`{fv.COL_INTERVAL}`")
    start, end = interval_bounds(interval)
    part = lambda n: F.substring_index(F.substring_index(resource, ":", n), ":", -1)
    return report.where(
        (F.col(f"`{fv.COL_OPERATION}`") == fv.SNAPSHOT_OPERATION) & resource.rlike(fv.SNAPSHOT_ARN)
    ).select(
        "seq",
        resource.alias("resource_id"),
        # The filter has settled the shape, so plain splits do for the parts.
        part(4).alias("region"),
        part(5).alias("owner_id"),
        F.substring_index(resource, "/", -1).alias("snapshot_id"),
        interval.alias("time_interval"),
        F.when(is_interval(interval), epoch_seconds(start)).alias("start_seconds"),
        epoch_seconds(end).alias("end_seconds"),
        F.col(f"`{fv.COL_AMOUNT}`").alias("amount_text"),
        F.col(f"`{fv.COL_RATE}`").alias("rate_text"),
    )


def _readable() -> Column:
    return F.col("start_seconds").isNotNull() & F.col("end_seconds").isNotNull()


def parse_usage(report: DataFrame) -> DataFrame:
    """Snapshot usage lines of a report, typed.

    ``report`` has the report's text columns by name plus ``seq``, the position
    of the line. Lines of other operations or resources are left out; lines
    whose interval cannot be read are listed by ``rejected_usage`` instead.
    """
    return (
        _snapshot_lines(report)
        .where(_readable())
        .select(
            "seq",
            "resource_id",
            "region",
            "owner_id",
            "snapshot_id",
            "start_seconds",
            (F.col("end_seconds") - F.col("start_seconds")).alias("interval_seconds"),
            parse_float_lenient(F.col("amount_text")).alias("usage_amount"),
            parse_float_lenient(F.col("rate_text")).alias("unblended_rate"),
        )
    )


def rejected_usage(report: DataFrame) -> DataFrame:
    """Snapshot usage lines whose time interval cannot be read."""
    return _snapshot_lines(report).where(~_readable()).select("seq", "resource_id", "time_interval")


def in_regions(usage: DataFrame, regions: Sequence[str] | None) -> DataFrame:
    """Keep the listed regions; all of them when no list is given."""
    return usage if regions is None else usage.where(F.col("region").isin(list(regions)))


def latest_usage(usage: DataFrame) -> DataFrame:
    """One row per resource: its newest amount, first rate and longest interval.

    Among lines with the newest start the earliest line wins. The orderings are
    fixed-width, so this stays one hash aggregate with map-side combining.
    """
    newest = order_key(F.col("start_seconds"), F.col("seq"), minor_descending=True)
    return usage.groupBy("region", "owner_id", "snapshot_id", "resource_id").agg(
        F.max("start_seconds").alias("start_seconds"),
        F.max("interval_seconds").alias("interval_seconds"),
        F.max_by("usage_amount", newest).alias("usage_amount"),
        F.min_by("unblended_rate", "seq").alias("unblended_rate"),
        F.min("seq").alias("seq"),
    )


def region_latest(usage: DataFrame) -> DataFrame:
    """Newest start per region, and where the region was first seen.

    Works on usage lines and, with the same result, on their ``latest_usage``.
    """
    return usage.groupBy("region").agg(
        F.max("start_seconds").alias("latest_seconds"), F.min("seq").alias("region_seq")
    )


def distinct_owners(usage: DataFrame) -> DataFrame:
    return usage.select("owner_id").distinct()


def monthly_usage(amount: Column, interval_seconds: Column) -> Column:
    """Amount projected to a 30-day month; IEEE result for a zero interval."""
    endless = (
        F.when(amount > 0, F.lit(float("inf")))
        .when(amount < 0, F.lit(float("-inf")))
        .otherwise(F.lit(float("nan")))
    )
    return F.when(interval_seconds == 0, endless).otherwise(amount * fv.MONTH_SECONDS / interval_seconds)


def current_usage(latest: DataFrame) -> DataFrame:
    """Resources billed in the newest period of their region, with monthly figures.

    Older ones are taken to be deleted. ``latest`` is ``latest_usage``, made
    ``durable`` so that the report is scanned only once for both uses here.
    """
    newest = region_latest(latest).select("region", F.col("latest_seconds").alias("start_seconds"))
    newest = with_rows(newest, latest, ["region", "start_seconds"])
    monthly = monthly_usage(F.col("usage_amount"), F.col("interval_seconds"))
    return (
        semi_join_spread(latest, newest, ["region", "start_seconds"], "resource_id")
        .withColumn("monthly_gb", monthly)
        .withColumn("monthly_cost", F.col("monthly_gb") * F.col("unblended_rate"))
    )
