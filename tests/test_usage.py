from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from coldledger.functions import fixed_values as fv
from coldledger.functions.text import epoch_seconds, fixed, parse_float_lenient, significant
from coldledger.operators import usage

REPORT = "seq bigint, " + ", ".join(f"`{c}` string" for c in fv.USAGE_COLUMNS)


def arn(snapshot, region="us-west-2", owner="123456789012"):
    return f"arn:aws:ec2:{region}:{owner}:snapshot/{snapshot}"


def day(n, hours=24):
    end = f"2017-05-{n + 1:02d}T00" if hours == 24 else f"2017-05-{n:02d}T{hours:02d}"
    return f"2017-05-{n:02d}T00:00:00Z/{end}:00:00Z"


LINES = [
    ("CreateSnapshot", arn("snap-a"), day(1), "1.5", "0.05"),
    ("CreateSnapshot", arn("snap-a"), day(3), "3.5", "0.09"),
    ("CreateSnapshot", arn("snap-a"), day(3), "99", "0.09"),  # same start, later line: ignored
    ("CreateSnapshot", arn("snap-b"), day(3, 1), "2GB", "0.05"),
    ("CreateSnapshot", arn("snap-b"), day(2), "7", "0.06"),
    ("CreateSnapshot", arn("snap-gone"), day(2), "7", "0.05"),
    ("CreateVolume", arn("snap-c"), day(3), "7", "0.05"),
    ("CreateSnapshot", "vol-1", day(3), "7", "0.05"),
    ("CreateSnapshot", arn("snap-d") + "\n", day(3), "7", "0.05"),
    ("CreateSnapshot", arn("SNAP-d"), day(3), "7", "0.05"),
    ("CreateSnapshot", arn("snap-e", "eu-west-1", "999999999999"), day(1), "5", "0.05"),
    ("CreateSnapshot", arn("snap-f"), "no interval", "7", "0.05"),
    ("CreateSnapshot", arn("snap-f"), "2017-05-01T00:00:00Z/2017-13-01T00:00:00Z", "7", "0.05"),
    ("CreateSnapshot", arn("snap-f"), "a/2017-05-01T00:00:00Z/2017-05-02T00:00:00Z", "7", "0.05"),
]


def report(spark, lines=LINES):
    rows = [(i, op, res, ival, amount, rate) for i, (op, res, ival, amount, rate) in enumerate(lines)]
    return spark.createDataFrame(rows, REPORT)


def test_parse(spark):
    rows = {r.seq: r for r in usage.parse_usage(report(spark)).collect()}
    assert sorted(rows) == [0, 1, 2, 3, 4, 5, 10]
    assert rows[3].usage_amount == 2.0 and rows[3].interval_seconds == 3600
    assert (rows[10].region, rows[10].owner_id, rows[10].snapshot_id) == ("eu-west-1", "999999999999", "snap-e")
    assert rows[0].start_seconds == 1493596800 and rows[0].interval_seconds == 86400


def test_rejected(spark):
    assert sorted(r.seq for r in usage.rejected_usage(report(spark)).collect()) == [11, 12, 13]


def test_latest(spark):
    latest = {r.snapshot_id: r for r in usage.latest_usage(usage.parse_usage(report(spark))).collect()}
    a, b = latest["snap-a"], latest["snap-b"]
    # Newest amount, earliest line among ties, rate of the first line, longest interval.
    assert (a.usage_amount, a.unblended_rate, a.seq) == (3.5, 0.05, 0)
    assert (b.usage_amount, b.unblended_rate, b.interval_seconds) == (2.0, 0.05, 86400)


def test_current_compares_with_region(spark):
    latest = usage.latest_usage(usage.parse_usage(report(spark)))
    assert {r.snapshot_id for r in usage.current_usage(latest).collect()} == {"snap-a", "snap-b", "snap-e"}
    regions = {r.region: r.region_seq for r in usage.region_latest(latest).collect()}
    assert regions == {"us-west-2": 0, "eu-west-1": 10}
    assert regions == {r.region: r.region_seq for r in usage.region_latest(usage.parse_usage(report(spark))).collect()}


def test_region_list(spark):
    parsed = usage.parse_usage(report(spark))
    assert usage.in_regions(parsed, ["eu-west-1"]).count() == 1
    assert usage.in_regions(parsed, None).count() == 7


def brute_latest(lines):
    state = {}
    for seq, (snapshot, start, amount, rate, interval) in enumerate(lines):
        if snapshot not in state:
            state[snapshot] = [start, amount, rate, interval, seq]
            continue
        kept = state[snapshot]
        kept[3] = max(kept[3], interval)
        if start > kept[0]:
            kept[0], kept[1] = start, amount
    return state


@pytest.mark.parametrize("partitions", [1, 7])
def test_latest_on_random_lines(spark, partitions):
    rng = random.Random(5)
    # One resource has a third of all lines.
    lines = [
        (
            "snap-hot" if rng.random() < 0.33 else f"snap-{rng.randrange(40)}",
            rng.randrange(20) * 86400,
            float(rng.randrange(1000)),
            rng.choice([0.05, 0.06]),
            rng.choice([3600, 86400]),
        )
        for _ in range(3000)
    ]
    rows = [(i, s, "r", "1", s, start, interval, amount, rate) for i, (s, start, amount, rate, interval) in enumerate(lines)]
    rng.shuffle(rows)
    schema = (
        "seq bigint, resource_id string, region string, owner_id string, snapshot_id string, "
        "start_seconds bigint, interval_seconds bigint, usage_amount double, unblended_rate double"
    )
    df = spark.createDataFrame(rows, schema).repartition(partitions)
    got = {
        r.snapshot_id: [r.start_seconds, r.usage_amount, r.unblended_rate, r.interval_seconds, r.seq]
        for r in usage.latest_usage(df).collect()
    }
    assert got == brute_latest(lines)


def test_monthly_usage(spark):
    rows = [(10.0, 86400), (10.0, 3600), (10.0, 0), (0.0, 0), (-1.0, 0)]
    df = spark.createDataFrame(rows, "a double, i bigint").select(usage.monthly_usage(F.col("a"), F.col("i")))
    got = [r[0] for r in df.collect()]
    assert got[:3] == [300.0, 7200.0, math.inf] and math.isnan(got[3]) and got[4] == -math.inf


@pytest.mark.parametrize(
    "text, number",
    [
        ("1.5GB", 1.5),
        ("", math.nan),
        ("  -2e3x", -2000.0),
        (".5", 0.5),
        ("5.", 5.0),
        ("+7", 7.0),
        ("1e", 1.0),
        ("abc", math.nan),
        ("-Infinity!", -math.inf),
        ("0x10", 0.0),
        ("1,234", 1.0),
        ("NaN", math.nan),
    ],
)
def test_parse_float(spark, text, number):
    got = spark.createDataFrame([(text,)], "t string").select(parse_float_lenient(F.col("t"))).first()[0]
    assert got == number or (math.isnan(got) and math.isnan(number))


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_epoch_seconds_ignores_session_zone(spark, zone):
    texts = [
        ("2017-05-01T00:00:00Z", 1493596800),
        ("2017-05-01T00:00:00", 1493596800),
        ("2017-05-01", 1493596800),
        ("2017-05-01T02:00:00+02:00", 1493596800),
        ("2017-05-01T00:00:00.500Z", 1493596800),
        ("2017-13-01T00:00:00Z", None),
        ("", None),
    ]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = spark.createDataFrame(texts, "t string, e bigint").select("e", epoch_seconds(F.col("t")).alias("g")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert [r.g for r in got] == [r.e for r in got]


@pytest.mark.parametrize(
    "value, digits, text",
    [
        (150.82, 3, "151"),
        (0.247, 3, "0.247"),
        (32.1, 2, "32"),
        (7.9, 2, "7.9"),
        (0.0694, 2, "0.069"),
        (100.0, 2, "100"),
        (1234.0, 3, "1230"),
        (99.96, 3, "100"),
        (0.0, 2, "0"),
        (12.5, 2, "13"),
        (12.499999999999998, 2, "13"),
        (-52.34, 2, "-52"),
    ],
)
def test_significant(spark, value, digits, text):
    assert spark.range(1).select(significant(F.lit(value), digits)).first()[0] == text


def test_fixed(spark):
    got = spark.range(1).select(fixed(F.lit(0.04), 1, 4), fixed(F.lit(448.7), 1, 4), fixed(F.lit(166.155), 2)).first()
    assert tuple(got) == (" 0.0", "448.7", "166.16")
