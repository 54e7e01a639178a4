from __future__ import annotations

import gzip
import hashlib
import io
import math
import os
import random
import tarfile

import pytest
from pyspark.sql import functions as F

from coldledger.functions import fixed_values as fv
from coldledger.functions.paths import strip_directory, strip_root
from coldledger.operators import manifests, usage
from coldledger.sources import archives, directories, manifest_files, reports, usage_csv

HELLO, GOODBYE = b"Hello, world!", b"Goodbye, world!"
HELLO_MD5, GOODBYE_MD5 = "6cd3556deb0da54bca060b4c39479839", "f6da94e9c2d5ac46e9e8ecee3a1731ff"
LATIN1 = bytes.fromhex("746573742d456e206672616ee76169732c207327696c20766f757320706c61ee743f2e747874")
UTF8 = "test-En français, s'il vous plaît?.txt".encode()

HEADER = "lineItem/Operation,extra,lineItem/UsageAmount,identity/TimeInterval,lineItem/ResourceId,lineItem/UnblendedRate"
ARN = "arn:aws:ec2:eu-west-1:123456789012:snapshot/snap-0123456789abcdef0"
BODY = 'CreateSnapshot,"a, ""quoted"" cell",1.5,s/e,r1,0.05\nCreateVolume,"line\nbreak",2GB,s/e,r2,0.06\n'
EXPECTED = [("CreateSnapshot", "r1", "s/e", "1.5", "0.05"), ("CreateVolume", "r2", "s/e", "2GB", "0.06")]


def read(spark, paths, **options):
    rows = usage_csv.read_usage_report(spark, paths, **options).orderBy("seq").collect()
    return [tuple(r[c] for c in fv.USAGE_COLUMNS) for r in rows]


def test_report_plain_and_gzip(spark, tmp_path):
    plain, packed = tmp_path / "r.csv", tmp_path / "r.csv.gz"
    plain.write_text(f"{HEADER}\n{BODY}")
    packed.write_bytes(gzip.compress(plain.read_bytes()))
    assert read(spark, str(plain)) == EXPECTED
    assert read(spark, str(packed)) == EXPECTED


def test_reports_with_other_column_orders(spark, tmp_path):
    first, second = tmp_path / "1.csv", tmp_path / "2.csv"
    first.write_text(f"{HEADER}\n{BODY}")
    names = list(reversed(fv.USAGE_COLUMNS))
    second.write_text(",".join(names) + "\n5,4,3,2,1\n")
    # The order of the paths is the order of the lines.
    assert read(spark, [str(second), str(first)]) == [("1", "2", "3", "4", "5"), *EXPECTED]


def test_hidden_gzip_and_missing_column(spark, tmp_path):
    hidden, named, short = tmp_path / "r e%1.csv", tmp_path / "r.csv.gz", tmp_path / "s.csv"
    hidden.write_bytes(gzip.compress(f"{HEADER}\n{BODY}".encode()))
    named.write_bytes(hidden.read_bytes())
    short.write_text("lineItem/Operation\nx\n")
    assert read(spark, str(hidden)) == read(spark, str(named)) == EXPECTED
    assert read(spark, [str(named), str(hidden)]) == EXPECTED + EXPECTED
    with pytest.raises(ValueError, match="lineItem/ResourceId"):
        read(spark, str(short))


def test_order_of_lines_in_split_files(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text(HEADER + "\n" + "".join(f"CreateSnapshot,x,{i},s/e,r,0.05\n" for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        got = read(spark, str(path), multi_line=False)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [int(r[3]) for r in got] == list(range(20_000))


def test_line_breaks_in_split_files(spark, tmp_path):
    """An error in plain files, wherever the cell is; gzip files are not split and may have them."""
    plain, packed = tmp_path / "r.csv", tmp_path / "r.csv.gz"
    packed.write_bytes(gzip.compress(f"{HEADER}\n{BODY}".encode()))
    assert read(spark, str(packed), multi_line=False) == EXPECTED
    cells = "CreateSnapshot,{},1.5,s/e,r1,{}\n"
    for odd in ['"line\nbreak"', '"a ""b\nc"', '"""\nb"', '"x,\n1,2,3,4,5,6"', '"\n"']:
        for line in (cells.format(odd, "0.05"), cells.format("x", odd), cells.format('5" disk', odd)):
            plain.write_text(f"{HEADER}\n{cells.format('y', '0.05')}{line}")
            with pytest.raises(ValueError, match="multi_line=True"):
                read(spark, [str(packed), str(plain)], multi_line=False)
    row = ("CreateSnapshot", "r1", "s/e", "1.5", "0.05")
    sound = ['"a, ""quoted"" cell"', '""', '"""a"""', '"a"","', '5" disk', 'x""', '"' + 'a""' * 20_000 + '"']
    plain.write_text(f"{HEADER}\n" + "".join(cells.format(cell, "0.05") for cell in sound))
    assert read(spark, str(plain), multi_line=False) == read(spark, str(plain)) == [row] * len(sound)


def test_line_breaks_are_found_across_blocks(spark, tmp_path):
    """Cells with line breaks, quotes and long texts, in blocks far smaller than some cells."""
    rng = random.Random(4)
    cells = ["x", "", '"line\nbreak"', '"a ""b\nc"', '"""\nb"', '"x,\n1,2,3,4,5,6"', '"\n"', '5" disk', 'x""', '"a, ""q"" c"', '"\r\ny"', '"' + "long\n,1,2\n" * 900 + '"', '"' + "z" * 9000 + '\n"']
    lines = [f"CreateSnapshot,{rng.choice(cells)},{i},s/e,{rng.choice(cells)},0.05\n" for i in range(1500)]
    path = tmp_path / "r.csv"
    path.write_text(HEADER + "\n" + "".join(lines), newline="")
    whole = tmp_path / "w.csv.gz"
    whole.write_bytes(gzip.compress(path.read_bytes()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    spark.conf.set("spark.sql.files.openCostInBytes", "16k")
    try:
        report = usage_csv.read_usage_report(spark, str(path))
        got = read(spark, str(path))
        assert len(report.select("seq").distinct().collect()) == 1500
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [int(r[3]) for r in got] == list(range(1500))
    assert got == read(spark, str(whole))


def test_report_written_and_read(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text(f"{HEADER}\n{BODY}")
    target = str(tmp_path / "out")
    usage_csv.write_usage_report(usage_csv.read_usage_report(spark, str(path)), target)
    assert sorted(read(spark, target)) == sorted(EXPECTED)


def test_order_of_files_is_not_their_size(spark, tmp_path):
    """Spark deals larger files first; of lines with the same start, the earliest counts."""
    folder = tmp_path / "parts of a report"
    folder.mkdir()
    line = f"CreateSnapshot,x,{{}},2024-01-01T00:00:00Z/2024-01-02T00:00:00Z,{ARN},{{}}\n"
    (folder / "1.csv").write_text(f"{HEADER}\n" + line.format("1.0", "0.05"))
    (folder / "2.csv").write_text(f"{HEADER}\n" + line.format("9.0", "0.09") * 500)
    for paths, amount, rate in [
        (str(folder), 1.0, 0.05),
        ([str(folder / "1.csv"), str(folder / "2.csv")], 1.0, 0.05),
        ([str(folder / "2.csv"), str(folder / "1.csv")], 9.0, 0.09),
    ]:
        report = usage_csv.read_usage_report(spark, paths)
        assert report.select("seq").distinct().count() == 501
        (row,) = usage.latest_usage(usage.parse_usage(report)).collect()
        assert (row.usage_amount, row.unblended_rate) == (amount, rate)


def test_many_files_are_read_without_a_job_each(spark, tmp_path):
    for i in range(200):
        (tmp_path / f"{i:04}.csv").write_text(f"{HEADER}\nCreateSnapshot,x,{i},s/e,r,0.05\n")
    (tmp_path / "0050.csv").write_text("")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "")
    try:
        report = usage_csv.read_usage_report(spark, str(tmp_path))
        assert len(tracker.getJobIdsForGroup("building")) <= 2
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [int(r[2]) for r in report.orderBy("seq").select("seq", "seq", f"`{fv.COL_AMOUNT}`").collect()] == [
        i for i in range(200) if i != 50
    ]


def test_empty_cells_are_no_numbers(spark, tmp_path):
    path = tmp_path / "r.csv"
    line = f'CreateSnapshot,x,{{}},2024-01-01T00:00:00Z/2024-01-02T00:00:00Z,{ARN},""\n'
    path.write_text(f"{HEADER}\n" + line.format(""))
    (row,) = usage.parse_usage(usage_csv.read_usage_report(spark, str(path))).collect()
    assert math.isnan(row.usage_amount) and math.isnan(row.unblended_rate)


def test_manifest_round_trip_of_random_bytes(spark, tmp_path):
    rng = random.Random(1)
    entries = {(bytes(rng.randrange(1, 256) for _ in range(rng.randrange(60))), f"{i:032x}") for i in range(300)}
    entries |= {(b"", "0" * 32), (LATIN1, HELLO_MD5), (b"two\nlines\r\n", HELLO_MD5)}
    df = spark.createDataFrame([(bytearray(n), h) for n, h in entries], "filename binary, hash string")
    path = str(tmp_path / "manifest")
    manifest_files.write_manifest(df.coalesce(1), path)
    back = manifest_files.read_manifest(spark, path).collect()
    assert {(bytes(r.filename), r.hash) for r in back} == entries and len(back) == len(entries)
    (part,) = [p for p in os.listdir(path) if p.startswith("part-")]
    with open(os.path.join(path, part), "rb") as written:
        assert sorted(written.read().split(b"\0")[:-1]) == sorted(h.encode() + b" " + n for n, h in entries)


def test_short_manifest_record(spark, tmp_path):
    path = tmp_path / "m"
    path.write_bytes(HELLO_MD5.encode() + b" a\0" + HELLO_MD5.encode() + b"\0")
    assert manifest_files.short_records(spark, str(path)).count() == 1
    with pytest.raises(Exception, match="manifest record of 32 bytes"):
        manifest_files.read_manifest(spark, str(path)).collect()


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    (root / "test-b" / "test-d").mkdir(parents=True)
    (root / ".hidden" / "_x").mkdir(parents=True)
    (root / "empty").mkdir()
    (root / "test-a.txt").write_bytes(HELLO)
    os.link(root / "test-a.txt", root / "test-hardlink.txt")
    os.symlink("test-a.txt", root / "test-symlink.txt")
    os.symlink("test-b", root / "test-linkdir")
    (root / "test-b" / "test-c.txt").write_bytes(GOODBYE)
    (root / "test-b" / "test-d" / "test-c.txt").write_bytes(b"Same filename but different content!")
    (root / ".hidden" / "_x" / "a:b").write_bytes(b"")
    big = random.Random(2).randbytes(3 * fv.READ_CHUNK_BYTES + 5)
    (root / "big").write_bytes(big)
    for name, content in ((UTF8, HELLO), (LATIN1, GOODBYE)):
        with open(os.fsencode(root) + b"/" + name, "wb") as out:
            out.write(content)
    expected = {
        b"test-a.txt": HELLO_MD5,
        b"test-hardlink.txt": HELLO_MD5,
        b"test-b/test-c.txt": GOODBYE_MD5,
        b"test-b/test-d/test-c.txt": "fd0a1f8a82e646dfa6cd2691e5bdf495",
        b".hidden/_x/a:b": "d41d8cd98f00b204e9800998ecf8427e",
        b"big": hashlib.md5(big).hexdigest(),
        UTF8: HELLO_MD5,
        LATIN1: GOODBYE_MD5,
    }
    return root, expected


@pytest.mark.parametrize("ending", ["", "/"])
def test_directory(spark, tree, ending):
    root, expected = tree
    rows = directories.hash_directory(spark, str(root) + ending).collect()
    assert {bytes(r.filename): r.hash for r in rows} == expected and len(rows) == len(expected)
    assert {bytes(r.filename): r.size for r in rows}[b"big"] == 3 * fv.READ_CHUNK_BYTES + 5


@pytest.mark.parametrize("kind", ["tar", "tar.gz", "tar.zst"])
@pytest.mark.parametrize("layout", [tarfile.GNU_FORMAT, tarfile.PAX_FORMAT])
def test_archive_matches_directory(spark, tree, tmp_path, kind, layout):
    root, expected = tree
    plain = io.BytesIO()
    with tarfile.open(fileobj=plain, mode="w", format=layout, encoding="utf-8", errors="surrogateescape") as tar:
        tar.add(str(root), arcname=".")
        long_name = "deep/" * 40 + "file"
        member = tarfile.TarInfo(long_name)
        member.size = len(HELLO)
        tar.addfile(member, io.BytesIO(HELLO))
    content = plain.getvalue()
    if kind == "tar.gz":
        content = gzip.compress(content)
    elif kind == "tar.zst":
        content = pytest.importorskip("zstandard").ZstdCompressor().compress(content)
    path = tmp_path / f"a.{kind}"
    path.write_bytes(content)
    found = archives.read_archives(spark, spark.createDataFrame([(str(path),)], "archive string"))
    manifest = manifests.require_resolved(manifests.resolve_hard_links(found))
    got = {bytes(r.filename): r.hash for r in manifest.collect()}
    assert got == expected | {long_name.encode(): HELLO_MD5}


def test_damaged_archive_fails(spark, tmp_path):
    plain = io.BytesIO()
    with tarfile.open(fileobj=plain, mode="w") as tar:
        member = tarfile.TarInfo("f")
        member.size = 5000
        tar.addfile(member, io.BytesIO(b"x" * 5000))
    path = tmp_path / "cut.tar"
    path.write_bytes(plain.getvalue()[:3000])
    found = archives.read_archives(spark, spark.createDataFrame([(str(path),)], "archive string"))
    with pytest.raises(Exception, match="missing at the end|unexpected end"):
        found.collect()


def test_paths(spark):
    names = [b"./a", b"/a", b"a", b".//a", b"./", b"", b".a", LATIN1, b"./" + LATIN1]
    df = spark.createDataFrame([(bytearray(n),) for n in names], "n binary").select(strip_root(F.col("n")).alias("n"))
    assert [bytes(r.n) for r in df.collect()] == [b"a", b"a", b"a", b"/a", b"", b"", b".a", LATIN1, LATIN1]
    outside = spark.createDataFrame([(bytearray(b"/mnt/volume/x"),)], "n binary")
    with pytest.raises(Exception, match="not below"):
        outside.select(strip_directory(F.col("n"), b"/mnt/vol")).collect()


def test_text_report(spark, tmp_path):
    lines = spark.range(1, 101).selectExpr("id AS position", "concat('line ', id) AS line").repartition(7)
    path = str(tmp_path / "report")
    reports.write_report(lines, path)
    text = "".join((tmp_path / "report" / p).read_text() for p in sorted(os.listdir(path)) if p.startswith("part-"))
    assert text.splitlines() == [f"line {i}" for i in range(1, 101)]


def test_bytes_of_a_file_with_three_names_count_once(spark, tmp_path):
    import subprocess

    root = tmp_path / "tree"
    (root / "a" / "b").mkdir(parents=True)
    (root / "a" / "one").write_bytes(b"x" * 70_000)
    os.link(root / "a" / "one", root / "two")
    os.link(root / "a" / "one", root / "a" / "b" / "three")
    (root / "empty").write_bytes(b"")
    (root / "other").write_bytes(b"y" * 33)
    (root / "pointer").symlink_to("other")
    # A file that has another name outside counts all the same.
    (tmp_path / "outside").write_bytes(b"z" * 11)
    os.link(tmp_path / "outside", root / "inside")
    row = directories.directory_size(spark, str(root)).first()
    assert (row.file_bytes, row.files) == (70_000 + 33 + 11, 4)
    du = int(subprocess.run(["du", "--bytes", "--summarize", root], capture_output=True, check=True).stdout.split()[0])
    assert row.total_bytes == du
    assert directories.directory_size(spark, str(root / "other")).first().total_bytes == 33


def test_files_are_dealt_by_bytes(spark):
    from coldledger.operators.skew import dealt_by_weight

    rows = [(i, 10**9 if i == 700 else 1000 + i) for i in range(4000)]
    small = sum(w for i, w in rows if i != 700)
    dealt = dealt_by_weight(spark.createDataFrame(rows, "id int, size bigint"), F.col("size"), 8)
    parts = dealt.groupBy(F.spark_partition_id().alias("part")).agg(F.sum("size").alias("bytes"), F.count("id").alias("n")).collect()
    assert sum(r.n for r in parts) == 4000 and len(parts) <= 8
    even = dealt_by_weight(spark.createDataFrame(rows, "id int, size bigint").where("id <> 700"), F.col("size"), 8)
    sums = [r.bytes for r in even.groupBy(F.spark_partition_id().alias("part")).agg(F.sum("size").alias("bytes")).collect()]
    assert len(sums) == 8 and max(sums) - min(sums) < 4 * 5000 and sum(sums) == small


@pytest.mark.parametrize("packed", [False, True])
def test_long_header_row_is_read_whole(spark, tmp_path, monkeypatch, packed):
    monkeypatch.setattr(usage_csv, "HEAD_BYTES", 64)
    wide = ",".join(f'"column {i}"' for i in range(200)) + ',"two\nlines",'
    content = (wide + HEADER + "\n" + "," * 201 + BODY.splitlines()[0] + "\n").encode()
    path = tmp_path / ("report.csv.gz" if packed else "report.csv")
    path.write_bytes(gzip.compress(content[:100]) + gzip.compress(content[100:]) if packed else content)
    assert read(spark, str(path)) == EXPECTED[:1]
    (tmp_path / "empty.csv").write_bytes(b"")
    assert read(spark, [str(path), str(tmp_path / "empty.csv")]) == EXPECTED[:1]
