from __future__ import annotations

import gzip
import os
import tarfile

import pytest

from coldledger.functions import fixed_values as fv
from coldledger.operators import manifests
from coldledger.plans import workflows
from tests.test_costs import REPORT_A, VOL_A, VOL_B, inputs

HELLO_MD5, CHANGED_MD5 = "6cd3556deb0da54bca060b4c39479839", "e0e7398575d117f63c4ecab9f685f2ba"


def test_analyse_report_files(spark, tmp_path):
    """The sample report, from CSV lines with older usage and other operations among them."""
    _, snapshots, volumes = inputs(spark)
    rows = [",".join(["other", *fv.USAGE_COLUMNS])]
    for volume, chain in (("a", VOL_A), ("b", VOL_B)):
        for i, (_, gb) in enumerate(chain):
            arn = f"arn:aws:ec2:us-west-2:123456789012:snapshot/snap-{volume}{i:02d}"
            for day, amount in (("24", gb * 2), ("25", gb), ("23", 1.0)):
                interval = f"2017-05-{day}T00:00:00Z/2017-05-{int(day) + 1}T00:00:00Z"
                rows.append(f'"x, y",CreateSnapshot,{arn},{interval},{amount / 30},0.05')
            rows.append(f"z,CreateVolume,{arn},{interval},7,0.9")
    # Billed the day before only: taken to be deleted.
    rows.append("z,CreateSnapshot,arn:aws:ec2:us-west-2:123456789012:snapshot/snap-old," + rows[1].split(",", 4)[4])
    path = tmp_path / "report.csv.gz"
    path.write_bytes(gzip.compress("\n".join(rows).encode()))
    lines = [r.line for r in workflows.analyse_report(spark, str(path), snapshots, volumes).orderBy("position").collect()]
    assert lines[0] == "Region us-west-2 ($151.07/month for 22 snapshots)"
    assert lines[1:18] == REPORT_A
    assert len(lines) == 28
    none = workflows.analyse_report(spark, str(path), snapshots, volumes, regions=["eu-west-1"])
    assert none.count() == 0


def test_analyse_report_with_line_breaks(spark, tmp_path):
    """Amounts behind a cell with a line break are neither lost nor changed, in plain and gzip files."""
    _, snapshots, volumes = inputs(spark)
    rows = [",".join([fv.USAGE_COLUMNS[0], "other", *fv.USAGE_COLUMNS[1:]])]
    for i, (_, gb) in enumerate(VOL_A):
        arn = f"arn:aws:ec2:us-west-2:123456789012:snapshot/snap-a{i:02d}"
        rows.append(f'CreateSnapshot,"x,{{}}y",{arn},2017-05-25T00:00:00Z/2017-05-26T00:00:00Z,{gb / 30},0.05')
    plain, broken, packed = tmp_path / "1.csv", tmp_path / "2.csv", tmp_path / "2.csv.gz"
    plain.write_text("\n".join(rows).replace("{}", " "))
    broken.write_text("\n".join(rows).replace("{}", "\n"))
    packed.write_bytes(gzip.compress(broken.read_bytes()))

    def lines(path, **options):
        found = workflows.analyse_report(spark, str(path), snapshots, volumes, **options).orderBy("position").collect()
        return [r.line for r in found]

    wanted = lines(plain, multi_line=False)
    assert f"for {len(VOL_A)} snapshots)" in wanted[0]
    assert lines(broken) == lines(packed) == lines(packed, multi_line=False) == wanted
    with pytest.raises(ValueError, match="unclosed quote"):
        lines(broken, multi_line=False)


@pytest.fixture
def links(tmp_path):
    root = tmp_path / "links"
    root.mkdir()
    (root / "test-a.txt").write_bytes(b"Hello, world!")
    os.link(root / "test-a.txt", root / "test-hardlink.txt")
    os.symlink("test-a.txt", root / "test-symlink.txt")
    path = tmp_path / "links.tar"
    with tarfile.open(path, "w") as tar:
        tar.add(root, arcname=".")
    return root, path


def test_validate_directory(spark, links):
    root, path = links
    summary = manifests.summarise_comparison(workflows.validate_directory(spark, str(root), [str(path)])).first()
    assert summary.identical and summary.matched == 2


def test_validate_changed_directory(spark, links):
    root, path = links
    with open(root / "test-a.txt", "ab") as out:
        out.write(b"!")
    found = workflows.validate_directory(spark, str(root), [str(path)])
    report = manifests.difference_report(found, "temporary volume", "stored tar").orderBy("position").collect()
    assert [r.message for r in report] == [
        f"Difference in file: {name}\nTemporary volume: {CHANGED_MD5}\nStored tar: {HELLO_MD5}"
        for name in ("test-a.txt", "test-hardlink.txt")
    ]


def test_validate_image(spark):
    schema = "snapshot_id string, hash string"
    originals = spark.createDataFrame([("s1", "a"), ("s2", "b")], schema)
    images = spark.createDataFrame([("s1", "a"), ("s2", "c")], schema)
    got = {r.snapshot_id: r.message for r in workflows.validate_image(originals, images).collect()}
    assert got == {"s1": None, "s2": "Hash of stored image (c) does not match the original (b)"}
