from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from coldledger.functions.tags import legal_text, sanitise_tags, volume_name
from coldledger.operators import catalogue

TAG = "archive-state"
SNAPSHOTS = (
    "snapshot_id string, volume_id string, start_time timestamp_ntz, description string, status string, "
    "owner_id string, volume_size bigint, tags array<struct<Key:string,Value:string>>, partitions array<string>"
)
WHEN = dt.datetime(2017, 1, 2, 3, 4, 5, 999_000)


def snapshots(spark, *rows):
    defaults = ("vol-1", WHEN, "weekly", "completed", "me", 8, [(TAG, "migrate")], ["", "data"])
    return spark.createDataFrame([(row[0], *row[1:], *defaults[len(row) - 1 :]) for row in rows], SNAPSHOTS)


def test_work_queue(spark):
    table = snapshots(
        spark,
        ("s2",),
        ("s1",),
        ("s0", "vol-1", WHEN + dt.timedelta(days=1)),
        ("pending", "vol-1", WHEN, "", "pending"),
        ("foreign", "vol-1", WHEN, "", "completed", "you"),
        ("migrated", "vol-1", WHEN, "", "completed", "me", 8, [(TAG, "migrated")]),
        ("other", "vol-1", WHEN, "", "completed", "me", 8, [("x", "migrate")]),
        ("untagged", "vol-1", WHEN, "", "completed", "me", 8, []),
        ("null", "vol-1", WHEN, "", "completed", "me", 8, None),
    )
    queue = catalogue.work_queue(table, TAG, "migrate", "me")
    assert {r.snapshot_id for r in queue.collect()} == {"s0", "s1", "s2"}
    assert [r.snapshot_id for r in catalogue.next_in_queue(queue).collect()] == ["s1"]
    assert catalogue.next_in_queue(catalogue.work_queue(table, TAG, "none", "me")).count() == 0


def test_missing(spark):
    requested = spark.createDataFrame([("s1",), ("s2",), ("s3",), ("s3",)], "snapshot_id string")
    missing = catalogue.missing_snapshots(requested, snapshots(spark, ("s1",)))
    assert {tuple(r) for r in missing.collect()} == {("s2", 1), ("s3", 2)}


BASE = "vol-1/2017-01-02T03:04:05+00:00 s1"


def objects(spark, *keys):
    return spark.createDataFrame([("b", k, len(k)) for k in keys], "bucket string, key string, size bigint")


def test_key_forms(spark):
    table = snapshots(spark, ("s1",), ("s1", "vol-1", WHEN, ""))
    images = [r.key_base for r in catalogue.with_image_key(table).collect()]
    assert images == [f"{BASE} - weekly.img", f"{BASE}.img"]
    parts = catalogue.with_archive_key(table.withColumn("partition_name", F.explode("partitions")))
    assert [r.key_base for r in parts.collect()] == [
        f"{BASE} - weekly.tar",
        f"{BASE} - weekly.data.tar",
        f"{BASE}.tar",
        f"{BASE}.data.tar",
    ]


@pytest.mark.parametrize(
    "endings, found",
    [
        ([".lz4", ".zstd", ".lz4.gpg", ".zstd.gpg"], ".zstd.gpg"),
        ([".lz4", ".zstd", ".lz4.gpg"], ".lz4.gpg"),
        ([".lz4", ".zstd"], ".zstd"),
        ([".lz4", ".gz", ".zstd.gpg.old"], ".lz4"),
        ([".gz", ".zst"], None),
    ],
)
def test_lookup_preference(spark, endings, found):
    wanted = catalogue.with_image_key(snapshots(spark, ("s1",)))
    base = f"{BASE} - weekly.img"
    listing = objects(spark, *[base + e for e in endings], "unrelated")
    row = catalogue.find_objects(wanted, listing, "b", "zstd", True).first()
    if found is None:
        assert row.found_key is None and row.found_size is None and row.found_encrypted is None
    else:
        assert (row.found_key, row.found_size) == (base + found, len(base + found))
        assert row.found_codec == found.split(".")[1] and row.found_encrypted == found.endswith(".gpg")
    assert catalogue.find_objects(wanted, listing, "elsewhere", "zstd", True).first().found_key is None


def test_description_with_line_break(spark):
    wanted = catalogue.with_image_key(snapshots(spark, ("s1", "vol-1", WHEN, "two\nlines")))
    key = f"{BASE} - two\nlines.img.lz4"
    assert catalogue.find_objects(wanted, objects(spark, key), "b", "zstd", True).first().found_key == key


def test_route(spark):
    table = snapshots(spark, ("s1", "vol-1", WHEN, ""), ("s2", "vol-1", WHEN, ""))
    listing = objects(
        spark, f"{BASE}.img.lz4", f"{BASE}.tar.lz4", BASE.replace("s1", "s2") + ".data.tar.zstd"
    )
    rows = catalogue.validation_route(table, listing, "b", "lz4", False).collect()
    assert {(r.snapshot_id, r.partition_name, r.route) for r in rows} == {
        ("s1", "", "image"),
        ("s2", "", "missing"),
        ("s2", "data", "archive"),
    }


def test_reusable_volumes(spark):
    me, you = [("me",)], [("you",)]
    rows = [
        ("v9", "s1", "z", [(TAG, "")], me),
        ("v5", "s1", "z", [(TAG, "x")], []),
        ("v1", "s1", "z", [(TAG, "x")], me + you),
        ("v2", "s1", "other", [(TAG, "x")], []),
        ("v3", "s1", "z", [("y", "x")], []),
        ("v4", "s2", "z", [(TAG, "x")], you),
    ]
    schema = (
        "volume_id string, snapshot_id string, availability_zone string, "
        "tags array<struct<Key:string,Value:string>>, attachments array<struct<InstanceId:string>>"
    )
    volumes = spark.createDataFrame(rows, schema)
    found = catalogue.reusable_volumes(snapshots(spark, ("s1",), ("s2",)), volumes, TAG, "z", "me")
    assert [tuple(r) for r in found.collect()] == [("s1", "v5")]


def test_volume_type(spark):
    rows = [(1024, "auto"), (1025, "auto"), (1, "io1")]
    df = spark.createDataFrame(rows, "s bigint, r string")
    got = df.select(catalogue.volume_type(F.col("s"), F.col("r")), catalogue.volume_type(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [("standard", "standard"), ("gp2", "gp2"), ("io1", "standard")]


def test_metadata(spark):
    row = snapshots(spark, ("s1",)).select(
        catalogue.object_metadata().alias("m"), catalogue.object_metadata(F.lit(7)).alias("n")
    ).first()
    assert row.m == {
        "snapshot-starttime": "2017-01-02T03:04:05+00:00",
        "snapshot-snapshotid": "s1",
        "snapshot-volumesize": "8",
        "snapshot-volumeid": "vol-1",
        "snapshot-description": "weekly",
    }
    assert row.n == row.m | {"uncompressed-size": "7"}


@pytest.mark.parametrize(
    "mode, ok, inline, prior, state",
    [
        ("migrate", True, False, "x", "migrated"),
        ("migrate", True, True, None, "validated"),
        ("migrate", False, True, "validated", "migrate"),
        ("validate", True, False, "x", "validated"),
        ("validate", False, False, "validated", "migrated"),
        ("validate", False, False, "validating", "migrated"),
        ("validate", False, False, "custom", "custom"),
        ("validate", False, False, None, ""),
    ],
)
def test_next_state(spark, mode, ok, inline, prior, state):
    df = spark.createDataFrame([(mode, ok, inline, prior)], "m string, o boolean, i boolean, p string")
    assert df.select(catalogue.next_state(F.col("m"), F.col("o"), F.col("i"), F.col("p"))).first()[0] == state


@pytest.mark.parametrize(
    "text, legal",
    [
        ("a(b)é", "a_b__"),
        ("tab\tand\nbreak", "tab\tand\nbreak"),
        ("no break　space﻿", "no break　space﻿"),
        ("smile 😀!", "smile ___"),
        ("+-=._:/", "+-=._:/"),
        ("x" * 300, "x" * 256),
        ("😀" * 200, "_" * 256),
    ],
)
def test_legal_text(spark, text, legal):
    assert spark.createDataFrame([(text,)], "t string").select(legal_text(F.col("t"))).first()[0] == legal


def test_tags(spark):
    tags = [(TAG, "migrate"), (TAG + "-id", "1"), ("aws:x", "y"), ("AWS:x", "y"), ("Name", "first"), ("Name", "second")]
    df = spark.createDataFrame([(tags,), ([],), (None,)], "t array<struct<Key:string,Value:string>>")
    rows = df.select(sanitise_tags(F.col("t"), TAG).alias("s"), volume_name(F.col("t")).alias("n")).collect()
    assert [tuple(t) for t in rows[0].s] == [("AWS:x", "y"), ("Name", "first"), ("Name", "second")]
    assert [r.n for r in rows] == ["first", "", ""]


def test_outcomes(spark):
    rows = [("s2", "validate", True, None), ("s1", "validate", True, None), ("s3", "validate", False, "broken"), ("s4", "migrate", False, "x")]
    df = spark.createDataFrame(rows, "snapshot_id string, mode string, ok boolean, message string")
    assert {tuple(r) for r in catalogue.outcome_counts(df).collect()} == {("validate", 2, 1), ("migrate", 0, 1)}
    lines = [r.line for r in catalogue.outcome_report(df).orderBy("position").collect()]
    assert lines == [
        "These snapshots validated successfully:",
        "s1",
        "s2",
        "These snapshots failed to validate:",
        "s3: broken",
    ]
    good = [r.line for r in catalogue.outcome_report(df.where("ok")).orderBy("position").collect()]
    assert good == lines[:3]
