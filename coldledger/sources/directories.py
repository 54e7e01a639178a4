"""Directory trees on a file system that every executor mounts.

Spark's own file listing skips empty and hidden files, follows links and loses
names that are not UTF-8, so directories are read with plain file calls inside
tasks. Paths and names are bytes.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.paths import strip_directory
from ..operators.skew import dealt_by_weight
from ..session import durable, ship_package

_BATCH = 10_000
#: Opening a file counts as much as reading so many bytes.
FILE_COST = 64 << 10


def task_count(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


_ENTRY = "path binary, kind string, size bigint, device bigint, inode bigint, links bigint"
_ENTRY_NAMES = [field.split(" ")[0] for field in _ENTRY.split(", ")]


def _described(path: bytes, kind: str, found: os.stat_result) -> tuple:
    # Identities are unsigned; as signed numbers of the same bits they are as good.
    signed = [value - 2**64 if value >= 2**63 else value for value in (found.st_dev, found.st_ino)]
    return (path, kind, found.st_size, *signed, found.st_nlink)


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    found: list[tuple] = []
    for batch in batches:
        for directory in batch["path"]:
            with os.scandir(bytes(directory)) as entries:
                for entry in entries:
                    kind = "other"
                    if entry.is_dir(follow_symlinks=False):
                        kind = "directory"
                    elif entry.is_file(follow_symlinks=False):
                        kind = "file"
                    found.append(_described(entry.path, kind, entry.stat(follow_symlinks=False)))
                    if len(found) >= _BATCH:
                        yield pd.DataFrame(found, columns=_ENTRY_NAMES)
                        found = []
    yield pd.DataFrame(found, columns=_ENTRY_NAMES)


def list_entries(spark: SparkSession, root: str | bytes) -> DataFrame:
    """Everything below ``root``: ``path, kind, size, device, inode, links``; symbolic links are not followed.

    ``kind`` is file, directory or other; device and inode tell which names are one file. One
    round per level of the tree, the directories of a level spread over all tasks. Each level is
    written out, so no directory is read twice.
    """
    ship_package(spark)
    start = os.fsencode(root).rstrip(b"/") or b"/"
    tasks = task_count(spark)
    frontier = spark.createDataFrame([(bytearray(start),)], "path binary")
    levels: list[DataFrame] = []
    while not frontier.isEmpty():
        level = durable(frontier.repartition(tasks, "path").mapInPandas(_entries, _ENTRY))
        levels.append(level)
        frontier = level.where(F.col("kind") == "directory").select("path")
    return reduce(DataFrame.unionByName, levels)


def list_files(spark: SparkSession, root: str | bytes) -> DataFrame:
    """Regular files below ``root`` as ``path, size``."""
    return list_entries(spark, root).where(F.col("kind") == "file").select("path", "size")


def directory_size(spark: SparkSession, root: str | bytes) -> DataFrame:
    """One row: ``total_bytes`` of ``root`` and all below it, folders included, and the ``file_bytes`` and
    ``files`` of these that are regular files; a file with several names counts once."""
    top = os.lstat(root)
    kind = "directory" if os.path.isdir(root) and not os.path.islink(root) else "file"
    own = spark.createDataFrame([_described(bytearray(os.fsencode(root)), kind, top)], _ENTRY)
    entries = list_entries(spark, root).unionByName(own) if kind == "directory" else own
    return distinct_size(entries)


def distinct_size(entries: DataFrame) -> DataFrame:
    """``total_bytes``, ``file_bytes`` and ``files`` of ``entries`` (those of ``list_entries``), each inode once.

    Only files that have several names anywhere are compared; the others are added up where they are.
    """
    single = (F.col("kind") == "directory") | (F.col("links") <= 1)
    shared = (
        entries.where(~single)
        .groupBy("device", "inode")
        .agg(F.max("size").alias("size"), F.max(F.col("kind") == "file").alias("is_file"))
    )
    each = entries.where(single).select("size", (F.col("kind") == "file").alias("is_file"))
    return each.unionByName(shared.select("size", "is_file")).agg(
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"),
        F.coalesce(F.sum(F.when(F.col("is_file"), F.col("size"))), F.lit(0)).alias("file_bytes"),
        F.count_if("is_file").alias("files"),
    )


def md5_of_stream(stream, length: int | None = None) -> str:
    """MD5 of the next ``length`` bytes (all if None), read in fixed-size chunks."""
    digest = hashlib.md5(usedforsecurity=False)
    left = length
    while left is None or left > 0:
        chunk = stream.read(fv.READ_CHUNK_BYTES if left is None else min(left, fv.READ_CHUNK_BYTES))
        if not chunk:
            if left:
                raise EOFError(f"{left} bytes missing at the end")
            break
        digest.update(chunk)
        left = None if left is None else left - len(chunk)
    return digest.hexdigest()


def _hash_paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        hashes = []
        for path in batch["path"]:
            with open(bytes(path), "rb") as stream:
                hashes.append(md5_of_stream(stream))
        yield batch.assign(hash=hashes)


def hash_directory(spark: SparkSession, root: str | bytes) -> DataFrame:
    """Manifest of a directory: ``filename`` below it, ``size`` and MD5 ``hash``.

    Files are dealt to tasks by their bytes before they are read, each with FILE_COST bytes more
    for being opened, so neither a full directory nor large files come together in one task.
    """
    files = dealt_by_weight(list_files(spark, root), F.col("size") + FILE_COST, task_count(spark))
    hashed = files.mapInPandas(_hash_paths, "path binary, size bigint, hash string")
    return hashed.select(strip_directory(F.col("path"), os.fsencode(root)).alias("filename"), "size", "hash")
