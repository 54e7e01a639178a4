"""The validation chain on hand-made snapshots."""

from __future__ import annotations

import datetime

import pytest

from coldledger.operators import catalogue, manifests, validation
from coldledger.session import durable

SNAPSHOTS = (
    "snapshot_id string, volume_id string, start_time timestamp_ntz, description string, "
    "partitions array<string>, tags array<struct<Key:string,Value:string>>"
)
HELLO, CHANGED = "6cd3556deb0da54bca060b4c39479839", "e0e7398575d117f63c4ecab9f685f2ba"
FILES = [("test-a.txt", HELLO), ("test-hardlink.txt", HELLO)]
START = datetime.datetime(2020, 1, 2)


def stem(name):
    return f"vol-1/2020-01-02T00:00:00+00:00 {name}"


@pytest.fixture(scope="module")
def chain(spark):
    def snapshot(name, partitions, tag):
        return (name, "vol-1", START, "", partitions, [] if tag is None else [("t", tag)])

    snapshots = spark.createDataFrame(
        [
            snapshot("snap-image", [""], "migrated"),
            snapshot("snap-imagebad", [""], "validated"),
            snapshot("snap-imagelost", [""], "migrated"),
            snapshot("snap-good", ["", "data"], "validating"),
            snapshot("snap-changed", ["", "data"], "validating"),
            snapshot("snap-gone", ["", "data"], "own"),
            snapshot("snap-none", [], None),
            snapshot("snap-nulls", None, None),
            snapshot("snap-untagged", ["root"], None),
            snapshot("snap-bare", [""], "migrated"),
        ],
        SNAPSHOTS,
    )
    keys = [
        stem("snap-image") + ".img.zstd",
        stem("snap-image") + ".tar.lz4",
        stem("snap-imagebad") + ".img.lz4.gpg",
        stem("snap-imagelost") + ".img.lz4",
        stem("snap-good") + ".tar.lz4",
        stem("snap-good") + ".data.tar.zstd.gpg",
        stem("snap-changed") + ".tar.lz4",
        stem("snap-changed") + ".data.tar.lz4",
        stem("snap-gone") + ".tar.lz4",
        stem("snap-bare") + ".tar.lz4",
        "unrelated", ".lz4", stem("snap-gone") + ".data.tar.gz",
    ]
    objects = spark.createDataFrame([("b", key, 5) for key in keys] + [("other", stem("snap-gone") + ".data.tar.lz4", 5)], "bucket string, key string, size bigint")
    local, stored = [], []
    for name, parts in (("snap-good", ["", "data"]), ("snap-changed", ["", "data"]), ("snap-gone", [""])):
        for part in parts:
            here = FILES if (name, part) != ("snap-changed", "data") else [(f, CHANGED) for f, _ in FILES]
            local += [(name, part, bytearray(f.encode()), h) for f, h in here]
            ending = ".data.tar.zstd.gpg" if (name, part) == ("snap-good", "data") else f"{'.' + part if part else ''}.tar.lz4"
            stored += [(stem(name) + ending, bytearray(f.encode()), h) for f, h in FILES]
    stored.append(("nobody's", bytearray(b"x"), HELLO))
    local_files = spark.createDataFrame(local, "snapshot_id string, partition_name string, filename binary, hash string")
    stored_files = spark.createDataFrame(stored, "key string, filename binary, hash string")
    images = spark.createDataFrame([("snap-image", HELLO), ("snap-imagebad", HELLO), ("snap-imagelost", HELLO)], "snapshot_id string, hash string")
    stored_images = spark.createDataFrame([(keys[0], HELLO), (keys[2], CHANGED)], "key string, hash string")
    routes = durable(catalogue.validation_route(snapshots, objects, "b", "lz4", False))
    compared = durable(validation.compare_archives(routes, local_files, stored_files))
    checks = durable(validation.partition_checks(routes, compared, images, stored_images, "b"))
    return snapshots, routes, compared, checks


def test_routes_and_expected_keys(chain):
    rows = {(r.snapshot_id, r.partition_name): (r.route, r.found_key, r.expected_key) for r in chain[1].collect()}
    assert len(rows) == 11
    assert rows["snap-image", ""] == ("image", stem("snap-image") + ".img.zstd", None)
    assert rows["snap-good", "data"] == ("archive", stem("snap-good") + ".data.tar.zstd.gpg", None)
    assert rows["snap-gone", "data"] == ("missing", None, stem("snap-gone") + ".data.tar.lz4")
    assert rows["snap-untagged", "root"] == ("missing", None, stem("snap-untagged") + ".root.tar.lz4")


def test_appended_byte_fails_its_partition(chain):
    wrong = chain[2].where("status <> 'match'").orderBy("filename").collect()
    assert [(bytes(r.filename).decode(), r.left_hash, r.right_hash) for r in wrong] == [
        ("test-a.txt", CHANGED, HELLO),
        ("test-hardlink.txt", CHANGED, HELLO),
    ]
    assert {r.archive for r in wrong} == {stem("snap-changed") + ".data.tar.lz4"}
    messages = [manifests.difference_message("local", "stored")]
    assert HELLO in chain[2].where("status <> 'match'").select(*messages).first()[0]


def test_outcomes(chain):
    snapshots, _, _, checks = chain
    outcomes = validation.validation_outcomes(snapshots, checks, "t").collect()
    found = {r.snapshot_id: (r.ok, r.checked, r.failed, r.new_tag) for r in outcomes}
    assert found == {
        "snap-image": (True, 1, 0, "validated"),
        "snap-imagebad": (False, 1, 1, "migrated"),
        "snap-imagelost": (False, 1, 1, "migrated"),
        "snap-good": (True, 2, 0, "validated"),
        "snap-changed": (False, 2, 1, "migrated"),
        "snap-gone": (False, 2, 1, "own"),
        "snap-none": (True, 0, 0, "validated"),
        "snap-nulls": (True, 0, 0, "validated"),
        "snap-untagged": (False, 1, 1, ""),
        "snap-bare": (True, 1, 0, "validated"),
    }
    said = {r.snapshot_id: r.message for r in outcomes}
    assert said["snap-gone"] == f"\"s3://b/{stem('snap-gone')}.data.tar.lz4\" should exist, but wasn't readable/found!"
    assert said["snap-imagebad"] == f"Hash of decompressed S3 object ({CHANGED}) does not match local temporary volume ({HELLO})"
    assert said["snap-good"] is None and "data.tar.lz4" in said["snap-changed"]


def test_keys_are_split_at_their_endings(spark):
    from coldledger.functions.keys import key_base, key_codec, key_encrypted
    from pyspark.sql import functions as F

    keys = ["a.tar.lz4", "a.img.zstd.gpg", "a.tar.gpg", "a", "", ".lz4", "a.lz4.zstd", "a.gpg.gpg", "a.lz4\n", "a\nb.lz4", None]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    rows = df.select(key_base(F.col("key")), key_codec(F.col("key")), key_encrypted(F.col("key"))).collect()
    assert [tuple(r) for r in rows] == [
        ("a.tar", "lz4", False),
        ("a.img", "zstd", True),
        ("", "", True),
        ("", "", False),
        ("", "", False),
        ("", "lz4", False),
        ("a.lz4", "zstd", False),
        ("", "", True),
        ("", "", False),
        ("a\nb", "lz4", False),
        (None, None, None),
    ]
