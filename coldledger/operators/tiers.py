"""Storage-tier what-if: full copies in object storage against snapshot chains.

A chain of ``n`` snapshots that each change by a fraction ``c`` is billed for
``1 + (n - 1) * c`` volumes; ``n`` full copies are billed for ``n`` volumes, times
the fraction that is left after compression. Tiers are a short list of
``(name, price per GB-month, minimum billed days)``, expanded as an array.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv

Tier = tuple[str, float, int]


def _tier_array(tiers: Sequence[Tier]) -> Column:
    return F.array(
        *[
            F.struct(F.lit(name).alias("tier"), F.lit(price).alias("price"), F.lit(days).cast("bigint").alias("min_days"))
            for name, price, days in tiers
        ]
    )


def per_tier(df: DataFrame, tiers: Sequence[Tier] = fv.TIERS) -> DataFrame:
    """Repeat every row per tier, adding ``tier, price, min_days``."""
    return df.select("*", F.inline(_tier_array(tiers)))


def tier_cost_ratio(
    price: Column, snapshots: Column, change: Column, compressed: Column, snapshot_price: float = fv.SNAPSHOT_PRICE
) -> Column:
    """Cost of full copies in a tier as a multiple of the snapshot chain's cost."""
    return snapshots * price * compressed / (snapshot_price * (1 + (snapshots - 1) * change))


def break_even_change(price: Column, compressed: Column, snapshot_price: float = fv.SNAPSHOT_PRICE) -> Column:
    """Change between snapshots above which a tier is cheaper for endless chains."""
    return price * compressed / snapshot_price


def migration_candidates(rollup: DataFrame, compressed: float = 1.0, tiers: Sequence[Tier] = fv.TIERS) -> DataFrame:
    """Per volume the cheapest place for its snapshots.

    ``tiers`` go from warm to cold. ``best_tier`` is the cheapest tier, or
    ``snapshot`` where none undercuts the chain; ``warmest_tier`` is the first
    one that does. Works row by row on the rollup, with no shuffle of its own.
    """
    change = F.coalesce("avg_change_pct", F.lit(0.0)) / 100
    options = F.transform(
        _tier_array(tiers),
        lambda t: F.struct(
            tier_cost_ratio(t["price"], F.col("snapshots"), change, F.lit(compressed)).alias("ratio"),
            t["tier"].alias("tier"),
        ),
    )
    cheaper = F.filter(F.col("_options"), lambda o: o["ratio"] < 1)
    stay = F.lit("snapshot")
    return (
        rollup.withColumn("_options", options)
        .withColumn("cost_ratio", F.array_min("_options")["ratio"])
        .withColumn("best_tier", F.coalesce(F.array_min(cheaper)["tier"], stay))
        .withColumn("warmest_tier", F.coalesce(F.try_element_at(cheaper, F.lit(1))["tier"], stay))
        .withColumn("monthly_saving", F.greatest(F.lit(0.0), F.col("monthly_cost") * (1 - F.col("cost_ratio"))))
        .drop("_options")
    )


def billed_days(stored_days: Column, min_days: Column) -> Column:
    """Days a tier charges for an object stored that long."""
    return F.greatest(stored_days, min_days)


def transfer_seconds(size_bytes: Column, workers: Column) -> Column:
    """Time to read volumes that were just created from snapshots."""
    return size_bytes / fv.READ_BYTES_PER_SECOND / workers
