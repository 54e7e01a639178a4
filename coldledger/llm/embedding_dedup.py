"""Near-duplicate embeddings by a tiled comparison in PCA order.

Vectors are rotated to their principal axes, which leaves cosines as they are, and sorted into
strips along the first axis. Tiles of two strips are compared a few axes at a time: the product
so far plus the product of the norms of what is left bounds the cosine, and a pair is given up
as soon as the bound is below the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.skew import with_positions
from ..session import durable, ship_package
from .arrays import batchwise, byte_view
from .components import least_of_components

THRESHOLD = 0.9
#: Vectors of a strip have so many bytes at most, so that two strips fit into a task.
STRIP_BYTES = 1 << 24
TILE = 1024
#: Axes after which the bound is tried; then at the end.
STEPS = (12, 24, 40)
#: Strips are told apart by their ranges on so many leading axes.
BOX_AXES = 8
#: Pairs of strips are dealt to so many tasks at most; a task compares its pairs one after another.
MOST_TASKS = 20_000
# Rotated products are exact to far less than this; closer calls are made on the vectors as given.
_DOUBT = 1e-9


def _packed(batches: Iterator[pa.RecordBatch], dtype: str) -> Iterator[pa.RecordBatch]:
    """The bytes of each usable vector, null for the others."""
    for batch in batches:
        keys: list[bytes | None] = []
        for vector in batch.column("vector"):
            values = vector.values
            if values is None or not len(values) or values.null_count:
                keys.append(None)
                continue
            row = values.to_numpy(zero_copy_only=False).astype(dtype) + 0.0
            keys.append(row.tobytes() if np.isfinite(row).all() and row.any() else None)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(keys, pa.binary())], ["id", "vector"])


def _units(raw: np.ndarray) -> np.ndarray:
    """Rows of ``raw`` scaled to length one, in double precision."""
    wide = raw.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.sqrt(np.einsum("ij,ij->i", wide, wide))[:, None]


def _rows(column: pa.Array, dtype: str) -> np.ndarray:
    data, offsets = byte_view(column)
    return data.view(dtype).reshape(len(offsets) - 1, -1)


def _moments(batches: Iterator[pa.RecordBatch], dtype: str, size: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros((size, size))
    for batch in batches:
        if batch.num_rows:
            units = _units(_rows(batch.column("vector"), dtype))
            total += units.T @ units
    i, j = np.indices(total.shape)
    arrays = [pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())]
    yield pa.RecordBatch.from_arrays(arrays, ["i", "j", "moment"])


def principal_axes(vectors: DataFrame, dtype: str, size: int) -> np.ndarray:
    """Axes (columns) in order of falling share of the vectors' energy; size * size sums reach the driver."""
    sums = (
        vectors.select("vector")
        .transform(batchwise, lambda batches: _moments(batches, dtype, size), "i bigint, j bigint, moment double")
        .groupBy("i", "j")
        .agg(F.sum("moment").alias("moment"))
        .toPandas()
    )
    total = np.zeros((size, size))
    total[sums["i"].to_numpy(np.int64), sums["j"].to_numpy(np.int64)] = sums["moment"]
    return np.ascontiguousarray(np.linalg.eigh((total + total.T) / 2)[1][:, ::-1])


def _leads(batches: Iterator[pa.RecordBatch], dtype: str, axes: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            lead = _units(_rows(batch.column("vector"), dtype)) @ axes[:, 0]
            yield batch.append_column("lead", pa.array(lead))


def _boxes(batches: Iterator[pa.RecordBatch], dtype: str, axes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Ranges of the leading axes and the greatest norm of the rest, by strip."""
    head = min(BOX_AXES, len(axes))
    for batch in batches:
        if not batch.num_rows:
            continue
        turned = _units(_rows(batch.column("vector"), dtype)) @ axes
        strips = batch.column("strip").to_numpy()
        for strip in np.unique(strips):
            part = turned[strips == strip]
            rest = float(np.sqrt((part[:, head:] ** 2).sum(axis=1)).max())
            values = [(k, float(part[:, k].min()), float(part[:, k].max())) for k in range(head)] + [(head, 0.0, rest)]
            yield pa.RecordBatch.from_pylist(
                [{"strip": int(strip), "axis": k, "low": a, "high": b} for k, a, b in values],
                pa.schema([("strip", pa.int64()), ("axis", pa.int64()), ("low", pa.float64()), ("high", pa.float64())]),
            )


def _partners(boxes: np.ndarray, strip: int, least: float) -> np.ndarray:
    """Strips that may hold a vector near one of ``strip``. boxes: strip, axis, (low, high)."""
    head = boxes.shape[1] - 1
    low, high = boxes[:, :head, 0], boxes[:, :head, 1]
    a, b = low[strip], high[strip]
    best = np.maximum.reduce([low * a, low * b, high * a, high * b]).sum(axis=1)
    return np.flatnonzero(best + boxes[:, head, 1] * boxes[strip, head, 1] >= least - _DOUBT)


def _dealt(batches: Iterator[pa.RecordBatch], boxes: np.ndarray, least: float) -> Iterator[pa.RecordBatch]:
    """Each vector once for every pair of strips that it takes part in."""
    known: dict[int, np.ndarray] = {}
    count = len(boxes)
    for batch in batches:
        strips = batch.column("strip").to_numpy()
        for strip in np.unique(strips):
            if strip not in known:
                known[int(strip)] = _partners(boxes, int(strip), least)
            part = batch.filter(pa.array(strips == strip))
            for other in known[int(strip)]:
                first, second = min(strip, other), max(strip, other)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(part.num_rows, first * count + second)),
                        pa.array(np.full(part.num_rows, int(strip != first), np.int32)),
                        part.column("id"),
                        part.column("copies"),
                        part.column("vector"),
                    ],
                    ["pair", "side", "id", "copies", "vector"],
                )


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most one edge a node that connect the same nodes as all edges (u, v) do."""
    names, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    tied = label != np.arange(len(names))
    return names[tied], names[label[tied]]


class _Strip:
    def __init__(self, ids: np.ndarray, copies: np.ndarray, raw: np.ndarray, axes: np.ndarray) -> None:
        self.ids, self.copies, self.raw = ids, copies, raw
        self.turned = _units(raw) @ axes
        squares = np.cumsum(self.turned[:, ::-1] ** 2, axis=1)[:, ::-1]
        self.cuts = [c for c in STEPS if c < len(axes)] + [len(axes)]
        self.left = {c: np.sqrt(squares[:, c]) for c in self.cuts[:-1]}
        self.links = np.zeros(len(ids), np.int64)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x, y = a.astype(np.float64), b.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    y /= np.abs(y).max(axis=1, keepdims=True)
    products = np.einsum("ij,ij->i", x, y)
    return products / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))


def near_pairs(a: _Strip, rows: slice, b: _Strip, columns: slice, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and ``b`` of the pairs of two tiles whose cosine reaches ``least``."""
    first = a.cuts[0]
    x, y = a.turned[rows], b.turned[columns]
    products = x[:, :first] @ y[:, :first].T
    if first in a.left:
        open_pairs = products + np.outer(a.left[first][rows], b.left[first][columns]) >= least - _DOUBT
    else:
        open_pairs = products >= least - _DOUBT
    i, j = np.nonzero(open_pairs)
    value = products[i, j]
    for start, stop in zip(a.cuts, a.cuts[1:]):
        if not len(i):
            break
        if len(i) * 8 > open_pairs.size:
            value = value + (x[:, start:stop] @ y[:, start:stop].T)[i, j]
        else:
            value = value + np.einsum("ij,ij->i", x[i, start:stop], y[j, start:stop])
        bound = value
        if stop in a.left:
            bound = value + a.left[stop][rows][i] * b.left[stop][columns][j]
        going = bound >= least - _DOUBT
        i, j, value = i[going], j[going], value[going]
    i, j = i + rows.start, j + columns.start
    close = np.abs(value - least) <= _DOUBT
    if close.any():
        sure = np.ones(len(i), bool)
        sure[close] = _exact(a.raw[i[close]], b.raw[j[close]]) >= least
        i, j = i[sure], j[sure]
    return i, j


def _compared(strips: list[_Strip], least: float) -> Iterator[pa.RecordBatch]:
    a, b = strips[0], strips[-1]
    us, vs, held = [], [], 0
    for r in range(0, len(a.ids), TILE):
        rows = slice(r, min(r + TILE, len(a.ids)))
        for c in range(r if a is b else 0, len(b.ids), TILE):
            columns = slice(c, min(c + TILE, len(b.ids)))
            i, j = near_pairs(a, rows, b, columns, least)
            if a is b:
                above = i < j
                i, j = i[above], j[above]
            if not len(i):
                continue
            np.add.at(a.links, i, b.copies[j])
            np.add.at(b.links, j, a.copies[i])
            u, v = forest(a.ids[i], b.ids[j])
            us.append(u)
            vs.append(v)
            held += len(u)
            if held > 1 << 20:
                u, v = forest(np.concatenate(us), np.concatenate(vs))
                us, vs, held = [u], [v], 0
    for strip in {id(s): s for s in (a, b)}.values():
        some = np.flatnonzero(strip.links)
        yield _found(strip.ids[some], None, strip.links[some])
    if us:
        u, v = forest(np.concatenate(us), np.concatenate(vs))
        yield _found(u, v, None)


def _found(u: np.ndarray, v: np.ndarray | None, links: np.ndarray | None) -> pa.RecordBatch:
    none = pa.nulls(len(u), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(u), none if v is None else pa.array(v), none if links is None else pa.array(links)], ["u", "v", "links"]
    )


def _pairs(batches: Iterator[pa.RecordBatch], dtype: str, axes: np.ndarray, least: float) -> Iterator[pa.RecordBatch]:
    """Links and edges of each pair of strips; the rows of a pair follow one another, side by side."""
    pair, sides = None, ([], [])

    def finish() -> Iterator[pa.RecordBatch]:
        strips = []
        for held in sides:
            if held:
                table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                columns = (table.column(name).to_numpy() for name in ("id", "copies"))
                strips.append(_Strip(*columns, _rows(table.column("vector"), dtype), axes))
        yield from _compared(strips, least)

    for batch in batches:
        numbers = batch.column("pair").to_numpy()
        for start in [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist()] if batch.num_rows else []:
            number = numbers[start]
            stop = start + int(np.searchsorted(numbers[start:], number, side="right"))
            if number != pair and pair is not None:
                yield from finish()
                sides = ([], [])
            pair = number
            part = batch.slice(start, stop - start)
            side = part.column("side").to_numpy()
            for which in (0, 1):
                if (side == which).any():
                    sides[which].append(part.filter(pa.array(side == which)))
    if pair is not None:
        yield from finish()


def _links_of_size(classes: DataFrame, count: int, dtype: str, size: int, least: float) -> DataFrame:
    """u, v, links rows of all classes whose vectors have ``size`` components."""
    cores = classes.sparkSession.sparkContext.defaultParallelism
    strips_wanted = 1
    while strips_wanted * (strips_wanted + 1) < 4 * cores:
        strips_wanted += 1
    strip_rows = max(1, min(STRIP_BYTES // (8 * size), -(-count // strips_wanted)))
    axes = principal_axes(classes, dtype, size)
    led = classes.transform(
        batchwise,
        lambda batches: _leads(batches, dtype, axes), "id bigint, copies bigint, vector binary, lead double"
    )
    placed = durable(
        with_positions(led, [F.col("lead"), F.col("id")]).select(
            F.floor((F.col("position") - 1) / strip_rows).cast("long").alias("strip"), "id", "copies", "vector"
        )
    )
    count_strips = -(-count // strip_rows)
    # A few numbers a strip reach the driver.
    ranges = (
        placed.select("strip", "vector")
        .transform(batchwise, lambda batches: _boxes(batches, dtype, axes), "strip bigint, axis bigint, low double, high double")
        .groupBy("strip", "axis")
        .agg(F.min("low").alias("low"), F.max("high").alias("high"))
        .toPandas()
    )
    boxes = np.zeros((count_strips, min(BOX_AXES, size) + 1, 2))
    boxes[ranges["strip"].to_numpy(np.int64), ranges["axis"].to_numpy(np.int64)] = ranges[["low", "high"]].to_numpy()
    # Pairs of strips that their ranges do not tell apart; two strips are partners both ways.
    partners = sum(int((_partners(boxes, strip, least) >= strip).sum()) for strip in range(count_strips))
    dealt = placed.transform(
        batchwise,
        lambda batches: _dealt(batches, boxes, least), "pair bigint, side int, id bigint, copies bigint, vector binary"
    )
    return (
        dealt.repartition(min(max(1, partners), MOST_TASKS), "pair")
        .sortWithinPartitions("pair", "side")
        .transform(batchwise, lambda batches: _pairs(batches, dtype, axes, least), "u bigint, v bigint, links bigint")
    )


def near_duplicates(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", least: float = THRESHOLD
) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row.

    Vectors that are null, empty or zero, that hold null or non-finite components, or whose id is
    null link with nothing. Equal vectors are one class for the comparison and count one by one as
    links. Only vectors of equal length are compared. Rows that share an id are linked by their own
    vectors. An empty table gives an empty result; further columns do not matter, whatever their names.
    """
    ship_package(vectors.sparkSession)
    element = vectors.schema[vector].dataType.elementType
    dtype = "<f4" if isinstance(element, T.FloatType) else "<f8"
    source = vectors.select(
        F.col(f"`{vec_id}`").cast("long").alias("id"),
        F.col(f"`{vector}`").cast("array<float>" if dtype == "<f4" else "array<double>").alias("vector"),
    )
    packed = durable(source.transform(batchwise, lambda batches: _packed(batches, dtype), "id bigint, vector binary"))
    classes = durable(
        packed.where("vector IS NOT NULL AND id IS NOT NULL")
        .groupBy("vector")
        .agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
        # A number of its own, as rows that share an id may differ in their vectors.
        .select(F.monotonically_increasing_id().alias("id"), "least", "copies", "vector")
    )
    width = np.dtype(dtype).itemsize
    sizes = classes.groupBy((F.octet_length("vector") / width).cast("int").alias("size")).count().collect()
    found = None
    for size, count in sorted((r["size"], r["count"]) for r in sizes):
        part = classes.where(F.octet_length("vector") == size * width).drop("least")
        links = _links_of_size(part, count, dtype, size, least)
        found = links if found is None else found.unionByName(links)
    if found is None:
        return packed.select(
            F.col("id").alias("vec_id"),
            F.lit(0).cast("long").alias("n_links"),
            F.col("id").alias("component_id"),
            F.lit(True).alias("kept"),
        )
    found = durable(found)
    links = found.where("links IS NOT NULL").groupBy("u").agg(F.sum("links").alias("links"))
    edges = found.where("v IS NOT NULL").select("u", "v")
    reached = least_of_components(classes.select(F.col("id").alias("node"), "least"), edges)
    described = (
        classes.join(links, classes["id"] == links["u"], "left")
        .join(reached, classes["id"] == reached["node"])
        .select(
            classes["vector"].alias("of_vector"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
            F.col("reached").alias("component"),
        )
    )
    joined = packed.join(
        described, (packed["vector"] == described["of_vector"]) & packed["id"].isNotNull(), "left"
    )
    component = F.coalesce("component", "id")
    return joined.select(
        F.col("id").alias("vec_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
