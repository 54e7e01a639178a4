"""Archives packed in several frames are hashed by several tasks."""

from __future__ import annotations

import gzip
import hashlib
import io
import struct
import tarfile
import zlib

import numpy as np
import pytest

from coldledger.sources import archives, frames


def _zstd(content: bytes, step: int, **options) -> bytes:
    zstandard = pytest.importorskip("zstandard")
    pack = zstandard.ZstdCompressor(**options)
    pieces = [pack.compress(content[at : at + step]) for at in range(0, len(content), step)]
    return (b"\x52\x2a\x4d\x18" + struct.pack("<I", 5) + b"extra").join(pieces)


def _gzip_blocks(content: bytes, step: int) -> bytes:
    packed = b""
    for piece in [content[at : at + step] for at in range(0, len(content), step)] + [b""]:
        pack = zlib.compressobj(wbits=-15)
        body = pack.compress(piece) + pack.flush()
        head = b"\x1f\x8b\x08\x04" + bytes(6) + struct.pack("<H2sHH", 6, b"BC", 2, 18 + len(body) + 8 - 1)
        packed += head + body + struct.pack("<II", zlib.crc32(piece), len(piece))
    return packed


@pytest.fixture(scope="module")
def members():
    rng = np.random.default_rng(1)
    sizes = [0, 1, 700, 200_000, 0, 511, 512, 513, 90_000, *rng.integers(0, 3000, 120).tolist()]
    return {f"folder/{'long' * 40 if i == 5 else ''}{i}": rng.bytes(size) for i, size in enumerate(sizes)}


@pytest.fixture(scope="module")
def plain(members):
    content = io.BytesIO()
    with tarfile.open(fileobj=content, mode="w") as tar:
        for name, data in members.items():
            member = tarfile.TarInfo(name)
            member.size = len(data)
            tar.addfile(member, io.BytesIO(data))
    return content.getvalue()


def _packed(plain):
    return {
        "frames": (_zstd(plain, 10_000), True),
        "checksums": (_zstd(plain, 30_011, write_checksum=True), True),
        "blocks": (_gzip_blocks(plain, 7_000), True),
        "one frame": (_zstd(plain, len(plain)), False),
        "no sizes": (_zstd(plain, 10_000, write_content_size=False), False),
        "members": (gzip.compress(plain[:5000]) + gzip.compress(plain[5000:]), False),
    }


def test_packed_archives_give_the_same_members(spark, members, plain, tmp_path):
    for name, (content, _) in _packed(plain).items():
        (tmp_path / name).write_bytes(content)
    paths = [(str(path),) for path in tmp_path.iterdir()]
    found = archives.read_archives(spark, spark.createDataFrame(paths, "archive string")).collect()
    expected = [(name.encode(), hashlib.md5(data).hexdigest()) for name, data in members.items()]
    for (path,) in paths:
        rows = sorted((r for r in found if r.archive == path), key=lambda r: r.seq)
        assert [(bytes(r.name), r.hash) for r in rows] == expected, path


def test_only_files_of_several_known_frames_are_read_by_frames(plain, tmp_path):
    for name, (content, by_frames) in _packed(plain).items():
        found = frames.framed(io.BytesIO(content))
        assert (found is not None) == by_frames, name
        if found:
            reader = io.BufferedReader(found, 16)
            assert reader.read() == plain
            for at in (60_000, 5, 59_999, 0, len(plain) - 1, len(plain)):
                reader.seek(at)
                assert reader.read(100) == plain[at : at + 100]


def test_frames_are_dealt_to_several_tasks(spark, members, plain, tmp_path):
    (tmp_path / "a.tar.zst").write_bytes(_zstd(plain, 10_000))
    listed = archives.read_archives(spark, spark.createDataFrame([(str(tmp_path / "a.tar.zst"),)], "archive string"))
    with_rows = listed.selectExpr("spark_partition_id() AS part").distinct().count()
    assert with_rows > 1
    read = next(archives._list(iter([listed.select("archive").limit(1).toPandas()])))
    assert read["hash"].isna().all() and read["frame"].nunique() > 10


@pytest.mark.parametrize("cut", [100, 40_000])
@pytest.mark.parametrize("sizes", [True, False])
def test_cut_frames_fail(spark, plain, tmp_path, cut, sizes):
    (tmp_path / "a").write_bytes(_zstd(plain, 10_000, write_content_size=sizes)[:-cut])
    with pytest.raises(Exception, match="missing|unexpected end"):
        archives.read_archives(spark, spark.createDataFrame([(str(tmp_path / "a"),)], "archive string")).collect()
