"""Files in the shared folder that tasks write and read by themselves.

A task writes files under names of its own and returns rows that say what is where. Those rows
are written as a table, whose commit decides which files count: what a lost or repeated attempt
has left is named nowhere and is never read.
"""

from __future__ import annotations

import re
import uuid
from urllib.parse import urlparse

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A task reads at least and at most so many bytes of files, as cores allow.
LEAST_TASK_BYTES, MOST_TASK_BYTES = 1 << 23, 1 << 28


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of ``folder``, for any store that Arrow knows."""
    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    if urlparse(folder).scheme == "file":
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", folder)
    return fs.FileSystem.from_uri(folder)


def new_file(folder: str, ending: str) -> tuple[fs.FileSystem, str]:
    """A path in ``folder`` that no other attempt of a task takes."""
    store, path = opened(folder)
    store.create_dir(path, recursive=True)
    return store, f"{path}/{uuid.uuid4().hex}{ending}"


def spread_by_place(index: DataFrame) -> DataFrame:
    """``index`` (file, offset, length) in order of place, dealt to tasks by bytes to read: the index
    itself is too small for Spark to tell how much work it stands for."""
    total = index.agg(F.sum("length")).first()[0] or 0
    cores = index.sparkSession.sparkContext.defaultParallelism
    share = min(MOST_TASK_BYTES, max(LEAST_TASK_BYTES, total // (2 * cores)))
    return index.repartitionByRange(max(1, -(-total // share)), "file", "offset").sortWithinPartitions("file", "offset")
