"""Odd values that must not end a report."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from coldledger.functions import text
from coldledger.operators import catalogue
from coldledger.sources import archives


def test_significant_digits_of_odd_numbers(spark):
    values = [None, float("nan"), float("inf"), float("-inf"), 0.0, 1e20, 123.456]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    found = [r[0] for r in df.orderBy("i").select(text.significant(F.col("v"), 3)).collect()]
    assert found == [None, "NaN", "Infinity", "-Infinity", "0", "100000000000000000000", "123"]


def test_volume_without_attachments_is_free(spark):
    schema = (
        "volume_id string, snapshot_id string, availability_zone string, "
        "tags array<struct<Key:string,Value:string>>, attachments array<struct<InstanceId:string>>"
    )
    volumes = spark.createDataFrame([("v1", "s1", "z", [("t", "x")], None)], schema)
    snapshots = spark.createDataFrame([("s1",)], "snapshot_id string")
    found = catalogue.reusable_volumes(snapshots, volumes, "t", "z", "i").collect()
    assert [tuple(r) for r in found] == [("s1", "v1")]


def test_other_packers_are_refused_by_name(tmp_path):
    from contextlib import ExitStack

    path = tmp_path / "a.tar.lz4"
    path.write_bytes(b"\x04\x22\x4d\x18rest")
    with ExitStack() as stack, pytest.raises(ValueError, match="lz4"):
        archives._open(str(path), stack)
