from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from coldledger.functions import fixed_values as fv
from coldledger.operators import catalogue, tiers

# Published cost of each tier as a percentage of twelve snapshots,
# by change between snapshots. Columns: change, then standard, infrequent and
# archive, plain and at 2:1 compression.
PUBLISHED = """
0    550 300 96    280 150 48
1    500 270 86    250 140 43
2    450 250 79    230 120 39
3    420 230 72    210 110 36
4    380 210 67    190 104 33
5    360 190 62    180 97  31
10   260 140 46    130 71  23
15   210 110 36    104 57  18
20   170 94  30    86  47  15
30   130 70  22    64  35  11
40   102 56  18    51  28  8.9
50   85  46  15    42  23  7.4
75   60  32  10    30  16  5.2
100  46  25  8.0   23  12.5 4.0
"""
ROWS = [line.split() for line in PUBLISHED.strip().splitlines()]


def half_unit(text):
    """Half of the last printed digit's value; trailing zeros of hundreds are unknown."""
    if "." in text:
        return 0.05
    return 5 if len(text) == 3 and text.endswith("0") else 0.5


def test_published_ratios(spark):
    rows = [
        (float(change) / 100, fv.TIERS[i % 3][0], 1.0 if i < 3 else 0.5, text)
        for change, *cells in ROWS
        for i, text in enumerate(cells)
    ]
    df = spark.createDataFrame(rows, "change double, wanted string, compressed double, text string")
    ratio = tiers.tier_cost_ratio(F.col("price"), F.lit(fv.YEAR_OF_SNAPSHOTS), F.col("change"), F.col("compressed"))
    got = tiers.per_tier(df).where("tier = wanted").select("text", (ratio * 100).alias("pct")).collect()
    assert len(got) == 84
    assert [r for r in got if abs(r.pct - float(r.text)) > half_unit(r.text) + 1e-9] == []


def test_break_even(spark):
    point = lambda c: F.round(tiers.break_even_change(F.col("price"), F.lit(c)) * 100, 6)
    rows = tiers.per_tier(spark.range(1)).select("tier", point(1.0), point(0.5)).collect()
    assert {tuple(r) for r in rows} == {("standard", 46.0, 23.0), ("infrequent", 25.0, 12.5), ("archive", 8.0, 4.0)}


def test_candidates(spark):
    rows = [
        ("big change", 12, 100, 60.0, 50.0),
        ("some change", 12, 100, 60.0, 20.0),
        ("no change", 12, 100, 5.0, 0.0),
        ("endless", 10_000, 100, 5.0, 1.0),
        ("single", 1, 100, 5.0, None),
    ]
    df = spark.createDataFrame(rows, "volume_id string, snapshots bigint, size bigint, monthly_cost double, avg_change_pct double")
    got = {r.volume_id: (r.best_tier, r.warmest_tier) for r in tiers.migration_candidates(df).collect()}
    assert got == {
        "big change": ("archive", "standard"),
        "some change": ("archive", "infrequent"),
        "no change": ("archive", "archive"),
        "endless": ("snapshot", "snapshot"),
        "single": ("archive", "standard"),
    }


# Volume size in GiB, published upload memory in MiB for 1 and 4 streams.
MEMORY = [(1, 5, 20), (40, 5, 20), (100, 11, 46), (200, 23, 91), (400, 46, 180), (800, 91, 360), (1600, 180, 730), (3200, 360, 1500)]


@pytest.mark.parametrize("size, one, four", MEMORY)
def test_published_memory(spark, size, one, four):
    rows = [(size * 2**30, "zstd", 1.0, s) for s in (1.0, 4.0)]
    jobs = spark.createDataFrame(rows, "uncompressed_bytes bigint, codec string, level double, streams double")
    got = [r.memory_bytes / 2**20 for r in catalogue.upload_plan(jobs).orderBy("streams").collect()]
    # Published to two digits.
    assert got == [pytest.approx(one, rel=0.04), pytest.approx(four, rel=0.04)]


def test_upload_options(spark):
    rows = [
        (300 * 2**30, "zstd", 0.4, 0.0),
        (300 * 2**30, "lz4", 2.5, 2.5),
        (300 * 2**30, "gzip", 99.0, -3.0),
        (0, "lz4", -0.5, 1.0),
    ]
    jobs = spark.createDataFrame(rows, "uncompressed_bytes bigint, codec string, level double, streams double")
    got = [(r.codec_ok, r.level, r.streams, r.parts) for r in catalogue.upload_plan(jobs).collect()]
    assert got == [(True, 1, 1, 9000), (True, 3, 3, 9000), (False, 19, 1, 9000), (True, 1, 1, 0)]
    costs = [r.request_cost for r in catalogue.upload_plan(jobs).collect()]
    assert costs[0] == pytest.approx(0.045)


def test_days_and_transfer(spark):
    df = spark.createDataFrame([(10,), (40,), (400,)], "d bigint")
    got = [r[0] for r in df.select(tiers.billed_days(F.col("d"), F.lit(90))).collect()]
    assert got == [90, 90, 400]
    day = spark.range(1).select(tiers.transfer_seconds(F.lit(300 * 2**30), F.lit(1)) / 3600).first()[0]
    assert day == pytest.approx(24.4, abs=0.1)
