"""Plans that must keep their shape to hold at scale."""

from __future__ import annotations

import re

from coldledger.operators import catalogue, manifests, usage
from coldledger.plans import bindings as b

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df):
    """The plan with its scans in full."""
    query = df._jdf.queryExecution()
    return df.sparkSession._jvm.PythonSQLUtils.explainString(query, "formatted")


def exchanges(df):
    return len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition", plan(df)))


def test_latest_usage_is_one_hash_aggregate(spark):
    text = plan(usage.latest_usage(usage.parse_usage(b.usage_report(spark, SF))))
    assert "partial_max_by" in text and "SortAggregate" not in text and "ObjectHashAggregate" not in text
    assert exchanges(usage.latest_usage(usage.parse_usage(b.usage_report(spark, SF)))) == 1


def test_scans_are_pruned(spark, tmp_path):
    path = str(tmp_path / "report")
    b.usage_report(spark, SF).write.parquet(path)
    stored = spark.read.parquet(path)
    text = scans(usage.distinct_owners(usage.parse_usage(stored)))
    assert "EqualTo(`lineItem/Operation`,CreateSnapshot)" in text
    assert "UnblendedRate" not in re.search(r"ReadSchema: (.*)", text).group(1)


def test_work_queue_filters_are_pushed_down(spark, tmp_path):
    path = str(tmp_path / "snapshots")
    b.snapshots(spark, SF).write.parquet(path)
    text = scans(catalogue.work_queue(spark.read.parquet(path), b.TAG, "migrate", b.OWNER))
    assert "EqualTo(status,completed)" in text and f"EqualTo(owner_id,{b.OWNER})" in text
    assert exchanges(catalogue.work_queue(spark.read.parquet(path), b.TAG, "migrate", b.OWNER)) == 0


def test_lookup_shuffles_each_side_once(spark):
    wanted = catalogue.with_image_key(b.snapshots(spark, SF))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        listing = spark.createDataFrame([("b", "k", 1)], "bucket string, key string, size bigint")
        own = exchanges(wanted)
        assert exchanges(catalogue.find_objects(wanted, listing, "b", "lz4", False)) == own + 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_manifests_are_compared_without_sort_aggregates(spark, monkeypatch):
    plans = []
    real = manifests.durable

    def recorded(df):
        plans.append(plan(df))
        return real(df)

    monkeypatch.setattr(manifests, "durable", recorded)
    rows = spark.range(50).selectExpr("CAST(concat('f', id % 40) AS BINARY) AS filename", "md5(CAST(id AS STRING)) AS hash")
    plans.append(plan(manifests.compare_manifests(rows, rows.limit(30))))
    assert len(plans) >= 4 and not any("SortAggregate" in text for text in plans)
    # Packed hashes are plain numbers of one hash aggregate, with one shuffle.
    assert "partial_max" in plans[0] and plans[0].count("Exchange hashpartitioning") == 1


def test_hard_links_need_windows_for_repeated_names_only(spark, monkeypatch):
    plans = []
    real = manifests.durable

    def recorded(df):
        plans.append(plan(df))
        return real(df)

    monkeypatch.setattr(manifests, "durable", recorded)
    schema = "archive string, seq bigint, name binary, type string, linkname binary, hash string"
    members = spark.createDataFrame([("a", 1, b"f", "file", None, "0" * 32), ("a", 2, b"l", "link", b"f", None)], schema)
    found = manifests.resolve_hard_links(members)
    assert not any("SortAggregate" in text or "Window" in text for text in plans)
    assert {(r.seq, r.hash) for r in found.collect()} == {(1, "0" * 32), (2, "0" * 32)}
    # No name has several files, so the branch with windows joins with a staged table without rows.
    assert any(spark.read.parquet(folder).count() == 0 for folder in {f.rsplit("/", 1)[0] for f in found.inputFiles()})
