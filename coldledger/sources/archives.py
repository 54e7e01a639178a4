"""Members of tar archives, plain, gzip or zstd, on a mounted file system.

A plain archive is listed by seeking from header to header; its members are then
hashed by many tasks, so a very large archive is not one task's work. So is one
packed in several frames that tell their lengths: the listing unpacks the frames
that hold headers, and the members that begin in a frame are hashed together, each
to its end, in whatever frame that is. Other gzip and zstd archives can only be
read front to back, so there each archive is one task, streamed in fixed-size
chunks. Names are bytes.
"""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator
from contextlib import ExitStack

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from .directories import md5_of_stream, task_count
from .frames import GZIP_MAGIC, ZSTD_MAGIC, FramedFile, framed, skip, unpacked_from

# offset is where a member's content starts; in a file of frames, frame and frame_offset are where
# the frame with its first byte starts, packed and unpacked.
_SCHEMA = (
    "archive string, seq bigint, name binary, type string, linkname binary, size bigint, offset bigint, "
    "frame bigint, frame_offset bigint, hash string"
)
_PLACES = ["offset", "frame", "frame_offset"]
_COLUMNS = ["archive", "seq", "name", "type", "linkname", "size", *_PLACES, "hash"]
_BATCH = 10_000
# Unpacked bytes that are read for a header, and more headers if they follow.
_HEADER_BYTES = 1 << 16
_TYPES = {
    tarfile.REGTYPE: "file",
    tarfile.AREGTYPE: "file",
    tarfile.LNKTYPE: "link",
    tarfile.SYMTYPE: "symlink",
    tarfile.DIRTYPE: "directory",
}


def _as_bytes(name: str) -> bytes:
    return name.encode("utf-8", "surrogateescape")


# How files of other packers begin.
_REFUSED = {"lz4": b"\x04\x22\x4d\x18", "bzip2": b"BZh", "xz": b"\xfd7zX"}


def _open(archive: str, stack: ExitStack) -> tuple[tarfile.TarFile, bool, FramedFile | None]:
    """The archive, whether it can be read front to back only, and its frames if it has such."""
    stream = stack.enter_context(open(archive, "rb"))
    magic = stream.read(4)
    stream.seek(0)
    frames = None
    mode = "r:"
    if magic.startswith((GZIP_MAGIC, ZSTD_MAGIC)):
        frames = framed(stream)
        if frames:
            stream = stack.enter_context(io.BufferedReader(frames, _HEADER_BYTES))
        else:
            stream, mode = unpacked_from(stream, 0), "r|"
    for name, start in _REFUSED.items():
        if magic.startswith(start):
            raise ValueError(f"{archive} is packed by {name}, which is not read; unpack it first")
    tar = tarfile.open(fileobj=stream, mode=mode, encoding="utf-8", errors="surrogateescape")
    return stack.enter_context(tar), mode != "r:", frames


def _members(archive: str) -> Iterator[tuple]:
    with ExitStack() as stack:
        tar, streamed, frames = _open(archive, stack)
        seq = 0
        # next() instead of iteration, and an emptied list: tarfile would
        # otherwise remember every member.
        while (member := tar.next()) is not None:
            kind = _TYPES.get(member.type, "other")
            digest, places = None, (None, None, None)
            if kind == "file" and streamed:
                digest = md5_of_stream(tar.extractfile(member), member.size)
            elif kind == "file":
                frame = frames.frame_of(member.offset_data) if frames else (None, None)
                places = (member.offset_data, *frame)
            yield (
                archive,
                seq,
                _as_bytes(member.name),
                kind,
                _as_bytes(member.linkname),
                member.size,
                *places,
                digest,
            )
            seq += 1
            tar.members.clear()


def _list(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows: list[tuple] = []
    for batch in batches:
        for archive in batch["archive"]:
            for member in _members(archive):
                rows.append(member)
                if len(rows) >= _BATCH:
                    yield _frame(rows)
                    rows = []
    yield _frame(rows)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=_COLUMNS)
    return frame.astype(dict.fromkeys(_PLACES, "Int64"))


def _hashes(archive: str, members: pd.DataFrame) -> Iterator[str]:
    """Of members that begin in one frame, or of a plain archive, by their offsets."""
    with open(archive, "rb") as stream:
        frame = members["frame"].iloc[0]
        at = None
        if not pd.isna(frame):
            stream, at = unpacked_from(stream, int(frame)), int(members["frame_offset"].iloc[0])
        for offset, size in zip(members["offset"].astype("int64").tolist(), members["size"].tolist()):
            if at is None:
                stream.seek(offset)
            else:
                skip(stream, offset - at)
                at = offset + size
            yield md5_of_stream(stream, size)


def _hash_pending(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        batch = batch.sort_values(["archive", "seq"]).reset_index(drop=True)
        hashes = batch["hash"].tolist()
        pending = batch[batch["offset"].notna()]
        for (archive, _), members in pending.groupby(["archive", "frame"], dropna=False):
            for index, digest in zip(members.index, _hashes(archive, members)):
                hashes[index] = digest
        yield batch.assign(hash=hashes).astype(dict.fromkeys(_PLACES, "Int64"))


def read_archives(spark: SparkSession, archives: DataFrame) -> DataFrame:
    """Members of the archives listed in the column ``archive``, files hashed."""
    ship_package(spark)
    tasks = task_count(spark)
    listed = archives.select("archive").repartition(tasks, "archive").mapInPandas(_list, _SCHEMA)
    # Members of one frame go together, so that it is unpacked once; others are dealt one by one.
    spread = listed.repartition(tasks, "archive", F.coalesce("frame", "seq"))
    return spread.mapInPandas(_hash_pending, _SCHEMA).drop(*_PLACES)
