"""Views on Arrow batches that several operators share."""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Batches = Iterator[pa.RecordBatch]

#: Work is cut into slices of about so many bytes, whatever the batch size is.
SLICE_BYTES = 1 << 20


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the n + 1 offsets of its rows; null counts as empty."""
    rows = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = rows.buffers()
    if len(rows) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(rows) + 1, np.int64)
    places = np.frombuffer(offsets, np.int64)[rows.offset : rows.offset + len(rows) + 1]
    flat = np.frombuffer(data, np.uint8)[places[0] : places[-1]]
    return flat, places - places[0]


def texts_of(column: pa.Array) -> list[str]:
    return ["" if text is None else text for text in column.to_pylist()]


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows of about ``most_bytes`` of text; a longer text is a run of its own."""
    if batch.num_rows == 0:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths.astype(np.int64) + 16)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, with underscores added until no column of ``df`` has that name."""
    taken = {name.lower() for name in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def _give_back() -> None:
    """Return what this process has freed to the system, as far as its allocators can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(ctypes.util.find_library("c")), "malloc_trim", None)
    if trim is not None:
        trim(0)


def batchwise(df: DataFrame, work: Callable[[Batches], Batches], schema: T.StructType | str) -> DataFrame:
    """``df.mapInArrow``, where a task's worker gives its freed memory back at the end.

    Workers live on between tasks and stages; what the allocators of each had kept for reuse would
    add up beside the executor's heap.
    """

    def tidy(batches: Batches) -> Batches:
        try:
            yield from work(batches)
        finally:
            _give_back()

    return df.mapInArrow(tidy, schema)
