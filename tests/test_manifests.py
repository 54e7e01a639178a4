from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from coldledger.operators import manifests

MANIFEST = "filename binary, hash string"
MEMBERS = "archive string, seq bigint, name binary, type string, linkname binary, hash string"


def md5(text):
    return hashlib.md5(text if isinstance(text, bytes) else text.encode()).hexdigest()


def manifest(spark, entries):
    return spark.createDataFrame([(bytearray(name), hash_) for name, hash_ in entries], MANIFEST)


def merge(left, right):
    """Brute force: merge two sorted lists entry by entry."""
    left, right, found = sorted(left), sorted(right), []
    i = j = 0
    while i < len(left) or j < len(right):
        if j == len(right) or (i < len(left) and left[i][0] < right[j][0]):
            found.append((left[i][0], "only_left", left[i][1], None))
            i += 1
        elif i == len(left) or right[j][0] < left[i][0]:
            found.append((right[j][0], "only_right", None, right[j][1]))
            j += 1
        else:
            status = "match" if left[i][1] == right[j][1] else "differ"
            found.append((left[i][0], status, left[i][1], right[j][1]))
            i, j = i + 1, j + 1
    return sorted(found, key=str)


def compared(spark, left, right):
    rows = manifests.compare_manifests(manifest(spark, left), manifest(spark, right)).collect()
    return sorted([(bytes(r.filename), r.status, r.left_hash, r.right_hash) for r in rows], key=str)


HELLO, CHANGED = "6cd3556deb0da54bca060b4c39479839", "e0e7398575d117f63c4ecab9f685f2ba"
LINKS = [(b"test-a.txt", HELLO), (b"test-hardlink.txt", HELLO)]


def test_known_digests():
    assert md5("Hello, world!") == HELLO and md5("Hello, world!!") == CHANGED


def test_appended_byte_shows_in_both_names(spark):
    changed = [(name, CHANGED) for name, _ in LINKS]
    found = manifests.compare_manifests(manifest(spark, LINKS), manifest(spark, changed))
    assert {(bytes(r.filename), r.status, r.right_hash) for r in found.collect()} == {
        (b"test-a.txt", "differ", CHANGED),
        (b"test-hardlink.txt", "differ", CHANGED),
    }
    report = manifests.difference_report(found, "temporary volume", "S3 tar").orderBy("position").collect()
    assert [r.message for r in report] == [
        f"Difference in file: {name}\nTemporary volume: {HELLO}\nS3 tar: {CHANGED}"
        for name in ("test-a.txt", "test-hardlink.txt")
    ]


def test_report_ends_with_counts(spark):
    left = [*LINKS, (b"z", HELLO)]
    found = manifests.compare_manifests(manifest(spark, left), manifest(spark, [(b"b", HELLO)] + LINKS[:1]))
    report = manifests.difference_report(found, "temporary volume", "S3 tar").orderBy("position").collect()
    assert [r.message for r in report] == [
        "Only in S3 tar: b",
        "Only in temporary volume: test-hardlink.txt",
        "Only in temporary volume: z",
        "File counts differ!",
        "Temporary volume: 3 files, S3 tar: 2 files",
    ]


def test_same_manifest_matches(spark):
    found = manifests.compare_manifests(manifest(spark, LINKS), manifest(spark, LINKS))
    summary = manifests.summarise_comparison(found).first()
    assert summary.identical and summary.matched == 2 and not summary.counts_differ
    assert manifests.difference_report(found, "a", "b").count() == 0


def random_entries(rng, size):
    names = [b"hot"] * (size // 3) + [bytes([97 + rng.randrange(26), 200 + rng.randrange(3)]) for _ in range(size - size // 3)]
    # A third of the names are one, and a third of the contents are one.
    return [(name, md5("same" if rng.random() < 0.33 else str(rng.randrange(200)))) for name in names]


@pytest.mark.parametrize("seed, chunk", [(1, 65_536), (2, 7), (3, 1)])
def test_repeated_names_pair_in_hash_order(spark, monkeypatch, seed, chunk):
    monkeypatch.setattr(manifests, "_CHUNK", chunk)
    rng = random.Random(seed)
    left, right = random_entries(rng, 600), random_entries(rng, 500)
    expected = merge(left, right)
    assert compared(spark, left, right) == expected
    mirrored = [
        (name, {"only_left": "only_right", "only_right": "only_left"}.get(status, status), b, a)
        for name, status, a, b in expected
    ]
    assert compared(spark, right, left) == sorted(mirrored, key=str)
    assert {status for _, status, _, _ in compared(spark, left, left)} == {"match"}


def test_copies_are_numbered_without_gaps(spark):
    rng = random.Random(4)
    rows = manifests.compare_manifests(
        manifest(spark, random_entries(rng, 300)), manifest(spark, random_entries(rng, 200))
    ).collect()
    numbers = {}
    for row in rows:
        numbers.setdefault(bytes(row.filename), []).append(row.copy)
    assert all(sorted(n) == list(range(1, len(n) + 1)) for n in numbers.values())


def test_sorted_bytewise(spark):
    entries = [(b"b", "2"), (b"\xff", "1"), (b"a/b", "1"), (b"a", "1"), (b"b", "1"), (b"\xc3\xa9", "1"), (b"", "9")]
    rows = manifests.sort_manifest(manifest(spark, entries).repartition(3)).orderBy("position").collect()
    assert [(bytes(r.filename), r.hash) for r in rows] == sorted(entries)
    assert [r.position for r in rows] == list(range(1, len(entries) + 1))


def members(spark, rows):
    return spark.createDataFrame(
        [(a, s, bytearray(n), t, bytearray(link), h) for a, s, n, t, link, h in rows], MEMBERS
    )


CASES = [
    ("x", 0, b"./f", "file", b"", "h0"),
    ("x", 1, b"l1", "link", b"f", None),
    ("x", 2, b"/l2", "link", b"/f", None),
    ("x", 3, b"s", "symlink", b"f", None),
    ("x", 4, b"f", "file", b"", "h4"),
    ("x", 5, b"l3", "link", b"./f", None),
    ("x", 6, b"early", "link", b"late", None),
    ("x", 7, b"late", "file", b"", "h7"),
    ("x", 8, b"hop", "link", b"l1", None),
    ("x", 9, b"none", "link", b"absent", None),
    ("y", 0, b"other", "link", b"f", None),
    ("y", 1, b"d/", "directory", b"", None),
]


@pytest.mark.parametrize("span", [65_536, 3, 1])
def test_hard_links(spark, monkeypatch, span):
    monkeypatch.setattr(manifests, "_SEQ_SPAN", span)
    rows = manifests.resolve_hard_links(members(spark, CASES)).collect()
    got = {(r.archive, bytes(r.filename), r.seq): r.hash for r in rows}
    assert got == {
        ("x", b"f", 0): "h0",
        ("x", b"l1", 1): "h0",
        ("x", b"l2", 2): "h0",
        ("x", b"f", 4): "h4",
        ("x", b"l3", 5): "h4",
        ("x", b"early", 6): None,
        ("x", b"late", 7): "h7",
        ("x", b"hop", 8): None,
        ("x", b"none", 9): None,
        ("y", b"other", 0): None,
    }


@pytest.mark.parametrize("span", [65_536, 10])
def test_hard_links_of_one_target(spark, monkeypatch, span):
    """Most links point at one name that keeps coming back."""
    monkeypatch.setattr(manifests, "_SEQ_SPAN", span)
    rng = random.Random(6)
    rows, last, expected = [], {}, {}
    for seq in range(500):
        name = b"hot" if rng.random() < 0.7 else b"n%d" % rng.randrange(5)
        if rng.random() < 0.2:
            rows.append(("a", seq, name, "file", b"", f"h{seq}"))
            last[name] = f"h{seq}"
        else:
            rows.append(("a", seq, b"link%d" % seq, "link", name, None))
            expected[seq] = last.get(name)
    got = manifests.resolve_hard_links(members(spark, rows).repartition(5)).where("type = 'link'").collect()
    assert {r.seq: r.hash for r in got} == expected


def test_unresolved_link_fails(spark):
    with pytest.raises(Exception, match="hard link without an earlier target: early"):
        manifests.require_resolved(manifests.resolve_hard_links(members(spark, CASES[6:8]))).collect()


def test_empty_size(spark):
    empty = spark.createDataFrame([], "size bigint")
    assert tuple(manifests.manifest_size(empty).first()) == (0, 0)


def _paired(left, right):
    """Copies of each name in hash order, first with first."""
    found = []
    for name in {n for n, _ in left} | {n for n, _ in right}:
        sides = [sorted(h for n, h in rows if n == name) for rows in (left, right)]
        for copy in range(max(map(len, sides))):
            hashes = [side[copy] if copy < len(side) else None for side in sides]
            found.append((name, copy + 1, *hashes))
    return sorted(found)


def test_comparison_of_random_manifests_with_odd_hashes(spark):
    rng = random.Random(11)
    hashes = ["%032x" % rng.getrandbits(128) for _ in range(6)] + ["0" * 32, "f" * 32, "8" + "0" * 31, "", "A" * 32, "short", "0" * 33]

    def side():
        names = [b"n%d" % rng.randrange(60) for _ in range(70)] + [b"hot"] * 40
        return [(name, rng.choice(hashes)) for name in names]

    left, right = side(), side()
    schema = "filename binary, hash string"
    compared = manifests.compare_manifests(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema))
    rows = sorted((bytes(r.filename), r.copy, r.left_hash, r.right_hash) for r in compared.collect())
    assert rows == sorted(_paired(left, right), key=lambda r: r[:2])


def test_many_equal_records_are_numbered_by_all_tasks(spark):
    equal = spark.range(200_000).select(F.lit(b"same").alias("filename"), F.lit("0" * 32).alias("hash"))
    few = spark.createDataFrame([(b"a", "1"), (b"z", "2"), (b"z", "2")], "filename binary, hash string")
    numbered = manifests.sort_manifest(equal.unionByName(few)).withColumn("part", F.spark_partition_id())
    by_part = [r["count"] for r in numbered.where("hash = repeat('0', 32)").groupBy("part").count().collect()]
    assert len(by_part) >= 4 and max(by_part) <= 100_000
    summary = numbered.groupBy("filename").agg(
        F.min("position").alias("first"), F.max("position").alias("last"), F.count_distinct("position").alias("n")
    )
    assert {bytes(r.filename): (r.first, r.last, r.n) for r in summary.collect()} == {
        b"a": (1, 1, 1),
        b"same": (2, 200_001, 200_000),
        b"z": (200_002, 200_003, 2),
    }


def test_sorting_an_empty_manifest(spark):
    assert manifests.sort_manifest(spark.createDataFrame([], "filename binary, hash string")).count() == 0
