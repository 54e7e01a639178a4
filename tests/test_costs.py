from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from coldledger.operators import costs, skew

LATEST = (
    "region string, owner_id string, snapshot_id string, resource_id string, start_seconds bigint, "
    "interval_seconds bigint, usage_amount double, unblended_rate double, seq bigint"
)
SNAPSHOTS = (
    "region string, owner_id string, snapshot_id string, volume_id string, status string, description string, "
    "volume_size bigint, start_time timestamp_ntz"
)
VOLUMES = "region string, volume_id string, size bigint, tags array<struct<Key:string,Value:string>>"
OWNER = "123456789012"

# Sizes in GB by date, of a sample report.
VOL_A = [
    ("2016-11-01", 448.7), ("2016-12-01", 261.7), ("2017-01-01", 301.5), ("2017-02-01", 275.4), ("2017-03-01", 250.5),
    ("2017-04-01", 279.3), ("2017-05-01", 320.6), ("2017-05-17", 218.1), ("2017-05-18", 90.8), ("2017-05-19", 85.2),
    ("2017-05-20", 89.4), ("2017-05-21", 93.2), ("2017-05-22", 92.6), ("2017-05-23", 82.8), ("2017-05-24", 87.1),
    ("2017-05-25", 39.5),
]
VOL_B = [
    ("2015-04-27", 2.4), ("2015-05-04", 0.1), ("2015-06-01", 0.1), ("2015-06-29", 0.1), ("2016-04-25", 2.2),
    ("2016-09-08", 0.0),
]
REPORT_A = """\
vol-a (500GB, MySQL Slave DB): 3016 GB total, $151/month for 16 snapshots, average snapshot change 32%
                snap-a00  2016-11-01  448.7 GB
                snap-a01  2016-12-01  261.7 GB (52%)
                snap-a02  2017-01-01  301.5 GB (60%)
                snap-a03  2017-02-01  275.4 GB (55%)
                snap-a04  2017-03-01  250.5 GB (50%)
                snap-a05  2017-04-01  279.3 GB (56%)
                snap-a06  2017-05-01  320.6 GB (64%)
                snap-a07  2017-05-17  218.1 GB (44%)
                snap-a08  2017-05-18  90.8 GB (18%)
                snap-a09  2017-05-19  85.2 GB (17%)
                snap-a10  2017-05-20  89.4 GB (18%)
                snap-a11  2017-05-21  93.2 GB (19%)
                snap-a12  2017-05-22  92.6 GB (19%)
                snap-a13  2017-05-23  82.8 GB (17%)
                snap-a14  2017-05-24  87.1 GB (17%)
                snap-a15  2017-05-25  39.5 GB (7.9%)
""".splitlines()


def inputs(spark, *, extra_latest=(), extra_snapshots=()):
    latest, snapshots = [], []
    seq = 100
    for volume, size, chain in (("vol-a", 500, VOL_A), ("vol-b", 20, VOL_B)):
        for i, (date, gb) in enumerate(chain):
            snapshot = f"snap-{volume[-1]}{i:02d}"
            # Lines run against the dates, so that only the dates order the chain.
            seq -= 1
            latest.append(("us-west-2", OWNER, snapshot, "arn-" + snapshot, 1000, 86400, gb / 30, 0.05, seq))
            snapshots.append(
                ("us-west-2", OWNER, snapshot, volume, "completed", "", size, dt.datetime.fromisoformat(date))
            )
    volumes = [
        ("us-west-2", "vol-a", 500, [("Name", "MySQL Slave DB")]),
        ("us-west-2", "vol-unused", 7, []),
        ("eu-west-1", "vol-b", 9, []),
    ]
    return (
        spark.createDataFrame(latest + list(extra_latest), LATEST),
        spark.createDataFrame(snapshots + list(extra_snapshots), SNAPSHOTS),
        spark.createDataFrame(volumes, VOLUMES),
    )


def chain(spark, **kwargs):
    latest, snapshots, volumes = inputs(spark, **kwargs)
    described = costs.with_snapshots(latest, snapshots)
    return latest, described, costs.volume_rollup(described, volumes)


def test_sample_report(spark):
    lines = [r.line for r in costs.report_lines(*chain(spark)).orderBy("position").collect()]
    assert lines[0] == "Region us-west-2 ($151.07/month for 22 snapshots)"
    assert lines[1:18] == REPORT_A
    assert lines[18] == ""
    assert lines[19].startswith("vol-b (20GB, deleted): 5 GB total, $0.245/month for 6 snapshots, average snapshot change 2.1%")
    assert lines[20:22] == ["                snap-b00  2015-04-27   2.4 GB", "                snap-b01  2015-05-04   0.1 GB (0.5%)"]
    assert lines[25] == "                snap-b05  2016-09-08   0.0 GB (0%)"
    assert lines[26:] == ["", ""]


def test_rollup_and_names(spark):
    _, _, rollup = chain(spark)
    rows = {r.volume_id: r for r in rollup.collect()}
    assert set(rows) == {"vol-a", "vol-b"}
    a, b = rows["vol-a"], rows["vol-b"]
    assert (a.size, a.deleted, a.volume_name, a.snapshots) == (500, False, "MySQL Slave DB", 16)
    # The volume of the same name in another region does not count.
    assert (b.size, b.deleted, b.volume_name, b.snapshots) == (20, True, "", 6)
    assert a.avg_change_pct == pytest.approx((3016.4 - 448.7) / 16 / 500 * 100)


def test_deleted_volume_takes_first_seen_size(spark):
    when = dt.datetime(2017, 1, 1)
    extra_latest = [
        ("us-west-2", OWNER, f"snap-c{i}", f"arn-c{i}", 1000, 86400, 1.0, 0.05, 500 - i) for i in range(3)
    ]
    extra_snapshots = [
        ("us-west-2", OWNER, f"snap-c{i}", "vol-c", "completed", "", 10 + i, when) for i in range(3)
    ]
    _, _, rollup = chain(spark, extra_latest=extra_latest, extra_snapshots=extra_snapshots)
    assert [r.size for r in rollup.collect() if r.volume_id == "vol-c"] == [12]


def test_undescribed_foreign_and_pending_snapshots_drop_out(spark):
    when = dt.datetime(2017, 1, 1)
    extra_latest = [
        ("eu-west-1", OWNER, f"snap-e{i}", f"arn-e{i}", 1000, 86400, 1.0, 0.05, 600 + i) for i in range(3)
    ]
    extra_snapshots = [
        ("eu-west-1", OWNER, "snap-e0", "vol-e", "pending", "", 10, when),
        ("eu-west-1", "111111111111", "snap-e1", "vol-e", "completed", "", 10, when),
    ]
    latest, described, rollup = chain(spark, extra_latest=extra_latest, extra_snapshots=extra_snapshots)
    assert "eu-west-1" not in {r.region for r in described.collect()}
    # The region is still reported, with nothing in it.
    regions = {r.region: (r.monthly_cost, r.snapshots) for r in costs.region_rollup(latest, rollup).collect()}
    assert regions["eu-west-1"] == (0.0, 0) and regions["us-west-2"][1] == 22
    lines = [r.line for r in costs.report_lines(latest, described, rollup).orderBy("position").collect()]
    assert lines[-2:] == ["Region eu-west-1 ($0.00/month for 0 snapshots)", ""]


def test_hot_volume_is_split(spark, monkeypatch):
    _, described, rollup = chain(spark)
    columns = ["snapshot_id", "size", "deleted", "volume_name"]
    plain = sorted(map(tuple, costs.with_volumes(described, rollup).select(*columns).collect()))
    split = costs.with_volumes(described, rollup, part_rows=1)
    assert sorted(map(tuple, split.select(*columns).collect())) == plain
    assert len(plain) == 22


def test_changes(spark):
    _, described, rollup = chain(spark)
    rows = {r.snapshot_id: r for r in costs.snapshot_changes(costs.with_volumes(described, rollup)).collect()}
    assert rows["snap-a00"].is_first and rows["snap-a00"].change_pct is None
    assert rows["snap-a01"].change_pct == pytest.approx(261.7 / 500 * 100)
    assert sum(r.is_first for r in rows.values()) == 2


def test_volumes_by_cost(spark):
    rows = [
        ("r1", "v1", 5.0, 3), ("r1", "v2", 9.0, 2), ("r1", "v3", 5.0, 1), ("r2", "v4", 1.0, 4), ("r2", "v5", 2.0, 5),
    ]
    df = spark.createDataFrame(rows, "region string, volume_id string, monthly_cost double, volume_seq bigint")
    ranked = {r.volume_id: r.cost_rank for r in costs.volumes_by_cost(df.repartition(4)).collect()}
    assert ranked == {"v2": 1, "v3": 2, "v1": 3, "v5": 1, "v4": 2}


def test_join_spread_equals_plain_join(spark):
    facts = spark.range(5000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 0 ELSE id % 50 END AS k")
    dims = spark.range(49).selectExpr("id AS k", "id * 10 AS v")
    counts = facts.groupBy("k").count().withColumnRenamed("count", "rows")
    plain = sorted(map(tuple, facts.join(dims, "k", "left").select("id", "k", "v").collect()), key=str)
    spread = skew.join_spread(facts, dims, ["k"], counts, "id", part_rows=100)
    assert sorted(map(tuple, spread.select("id", "k", "v").collect()), key=str) == plain


@pytest.mark.parametrize("limit", [3, 1000])
def test_semi_join_spread(spark, limit):
    facts = spark.range(5000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 0 ELSE id % 50 END AS k")
    wanted = skew.with_rows(spark.createDataFrame([(0,), (7,), (99,)], "k bigint"), facts, ["k"])
    got = skew.semi_join_spread(facts, wanted, ["k"], "id", limit)
    expected = [i for i in range(5000) if (0 if i % 3 == 0 else i % 50) in (0, 7, 99)]
    assert sorted(r.id for r in got.collect()) == expected
    assert got.columns == ["id", "k"]


@pytest.mark.parametrize("scale", [1, 4])
def test_parts_follow_the_rows_of_a_key(spark, scale):
    counts = spark.createDataFrame([(0, 2000 * scale), (1, 999 * scale), (2, 1)], "k bigint, rows bigint")
    # A part holds at most a thousandth of all rows.
    share = (2999 * scale + 1) // 1000
    expected = {0: -(-2000 * scale // share), 1: -(-999 * scale // share)}
    got = {r.k: r._parts for r in skew.parts_per_key(counts, ["k"]).collect()}
    assert got == expected
    got = {r.k: r._parts for r in skew.parts_per_key(counts, ["k"], part_rows=2).collect()}
    assert got == {0: 1000 * scale, 1: -(-999 * scale // 2)}


def test_semi_join_of_many_keys_repeats_none_of_the_cold(spark):
    facts = spark.range(300_000).selectExpr("id", "id % 150000 AS k")
    wanted = skew.with_rows(spark.range(120_000).selectExpr("id AS k"), facts, ["k"])
    assert skew.parts_per_key(wanted, ["k"]).count() == 0
    assert skew.semi_join_spread(facts, wanted, ["k"], "id").count() == 240_000


def test_keys_of_many_parts_are_split_however_small_their_share(spark):
    counts = spark.createDataFrame([(k, 10) for k in range(5000)] + [(5000, 51)], "k long, rows long")
    got = {r.k: r._parts for r in skew.parts_per_key(counts, ["k"], part_rows=1).collect()}
    assert got == {5000: 51}


def test_numbering_computes_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    rows = spark.range(1000).mapInPandas(counted, "id long")
    numbered = skew.with_positions(rows, [F.col("id").desc()])
    assert numbered.agg(F.sum(F.col("position") + F.col("id"))).first()[0] == 1000 * 1000
    assert numbered.count() == 1000 and seen.value == 1000
    seen.add(-1000)
    copies = skew.sort_with_copies(rows.select(F.col("id") % 10), [F.col("(id % 10)")])
    assert copies.count() == 1000 and seen.value == 1000
