"""Whitening of embeddings along their leading components, found by Jacobi-Davidson.

The covariance is never formed: Spark multiplies it with blocks of columns, by one pass over the
distinct vectors for each block, centred before anything is multiplied. What reaches the driver is
as long as a vector, whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import durable, ship_package
from .arrays import batchwise
from .jacobi_davidson import largest_eigenpairs

COMPONENTS = 16
SCALE = 64
OFFSET = 1_000_000
# Scaled entries from here on are no longer told apart by their floors.
_MOST = 2.0**52
_SUMS = "place bigint, value double"


@dataclass(frozen=True)
class _Centre:
    """Sums of the fitted vectors, and their means as whole numbers and fractions."""

    count: int
    sums: list[int]
    floors: np.ndarray
    fractions: np.ndarray

    @staticmethod
    def of(count: int, sums: list[int]) -> _Centre:
        floors = [total // count for total in sums]
        fractions = [(total - floor * count) / count for total, floor in zip(sums, floors)]
        return _Centre(count, sums, np.array(floors, np.int64), np.array(fractions))

    def centred(self, column: pa.Array) -> np.ndarray:
        """Rows of ``column`` less the means; the whole numbers are subtracted exactly."""
        rows = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
        return (rows - self.floors).astype(np.float64) - self.fractions


def _finite(vector: Column) -> Column:
    """True for a vector without null, infinite and other entries that are no numbers."""
    whole = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(whole, F.lit(False))


def _whole_numbers(vector: Column) -> Column:
    def whole(c: Column) -> Column:
        scaled = c.cast("double") * F.lit(float(SCALE))
        too_large = F.raise_error(F.lit("an entry is too large to be told from its neighbours"))
        return F.when(F.abs(scaled) < _MOST, F.floor(scaled) + F.lit(OFFSET)).otherwise(too_large.cast("long"))

    return F.transform(vector, whole)


def _partial_sums(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Counts and sums of a task's vectors, in a high and a low part that cannot run over."""
    for batch in batches:
        rows = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(size)),
                pa.array(np.full(size, len(rows))),
                pa.array((rows >> 32).sum(axis=0)),
                pa.array((rows & 0xFFFFFFFF).sum(axis=0)),
            ],
            ["axis", "rows", "high", "low"],
        )


def _centre(fitted: DataFrame, size: int) -> _Centre:
    parts = fitted.transform(
        batchwise,
        lambda batches: _partial_sums(batches, size), "axis bigint, rows bigint, high bigint, low bigint"
    )
    wide = [F.sum(F.col(name).cast("decimal(20,0)")).alias(name) for name in ("rows", "high", "low")]
    found = sorted(parts.groupBy("axis").agg(*wide).collect())
    return _Centre.of(int(found[0]["rows"]), [int(row["high"]) * 2**32 + int(row["low"]) for row in found])


def _summed(fitted: DataFrame, partial: Callable[[np.ndarray], np.ndarray], centre: _Centre, shape: tuple) -> np.ndarray:
    """Sum over all vectors of what ``partial`` makes of blocks of centred ones, an array of ``shape``."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += partial(centre.centred(batch.column("x")))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["place", "value"])

    found = fitted.transform(batchwise, sums, _SUMS).groupBy("place").agg(F.sum("value").alias("value")).toPandas()
    total = np.zeros(int(np.prod(shape)))
    total[found["place"].to_numpy(np.int64)] = found["value"].to_numpy(np.float64)
    return total.reshape(shape)


def _product(fitted: DataFrame, centre: _Centre, size: int) -> Callable[[np.ndarray], np.ndarray]:
    """Multiplication of a block of columns by the covariance of the fitted vectors."""

    def product(block: np.ndarray) -> np.ndarray:
        def partial(rows: np.ndarray) -> np.ndarray:
            return rows.T @ (rows @ block)

        return _summed(fitted, partial, centre, (size, block.shape[1])) / centre.count

    return product


def _whitened(batches: Iterator[pa.RecordBatch], centre: _Centre, axes: np.ndarray, defined: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = centre.centred(batch.column("x")) @ axes
        lists = [[*row[:defined], *[None] * (axes.shape[1] - defined)] for row in found.tolist()]
        yield batch.append_column("whitened", pa.array(lists, pa.list_(pa.float64())))


def _deviation(x: Column, centre: _Centre) -> Column:
    count = F.lit(Decimal(centre.count)).cast("decimal(20,0)")
    sums = F.array(*[F.lit(Decimal(total)).cast("decimal(38,0)") for total in centre.sums])
    squares = F.zip_with(x, sums, lambda a, s: _squared((a.cast("decimal(19,0)") * count).cast("decimal(38,0)") - s))
    zero = F.lit(Decimal(0)).cast("decimal(38,0)")
    return F.aggregate(squares, zero, lambda total, square: (total + square).cast("decimal(38,0)"))


def _squared(x: Column) -> Column:
    whole = x.cast("decimal(38,0)")
    return (whole * whole).cast("decimal(38,0)")


def _of_one_size(rows: DataFrame, size: int, components: int) -> DataFrame:
    """Rows of ``size`` entries with their ``whitened`` coordinates and the figures of the fit."""
    fitted = durable(rows.select("x").distinct())
    centre = _centre(fitted, size)
    spread = float(_summed(fitted, lambda part: np.array([np.einsum("ij,ij", part, part)]), centre, (1,))[0]) / centre.count
    values, vectors = largest_eigenpairs(_product(fitted, centre, size), size, components)
    # Eigenvalues that rounding alone can make are zero: their components have no direction.
    defined = int((values > size * np.finfo(float).eps * values.max(initial=0)).sum())
    scaled = vectors.copy()
    scaled[:, :defined] /= np.sqrt(values[:defined])
    leading = scaled[:, :defined]

    def moments(part: np.ndarray) -> np.ndarray:
        found = part @ leading
        return np.vstack([found.T @ found, found.sum(axis=0)])

    error = 0.0
    if defined:
        sums = _summed(fitted, moments, centre, (defined + 1, defined)) / centre.count
        covariance = sums[:defined] - np.outer(sums[defined], sums[defined])
        error = float(np.abs(covariance - np.eye(defined)).max())
    share = [float(max(value, 0.0) / spread) if spread > 0 else None for value in values]
    schema = T.StructType([*rows.schema.fields, T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    return rows.transform(batchwise, lambda batches: _whitened(batches, centre, scaled, defined), schema).select(
        "kept_columns",
        F.lit(centre.count).cast("long").alias("n"),
        _deviation(F.col("x"), centre).alias("deviation"),
        "whitened",
        F.array(*[F.lit(value).cast("double") for value in share]).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def whiten(table: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``kept_columns`` (a struct of all columns of ``table``), ``n``, ``deviation`` (exact, a decimal),
    ``whitened`` and ``explained`` (a number for each component) and ``identity_error`` of each row
    whose vector has finite entries only.

    An entry c counts as floor(64 * c) + 1000000. The fit takes each distinct vector once; repeated
    rows, and rows with null ids, get their own result rows. Vectors of different lengths have
    nothing to do with each other: those of each length are fitted and whitened on their own. There
    are as many components as entries if these are fewer; a vector without entries has none, and no
    row. A component whose eigenvalue is zero but for rounding (constant entries, fewer vectors than
    components) has null ``whitened`` and no part in ``identity_error``; ``explained`` is null where
    nothing varies at all. Equal eigenvalues come in any order. An empty table gives an empty
    result. Columns may have any name. Entries of 2**52 / 64 or more fail the job.
    """
    ship_package(table.sparkSession)
    columns = [table[f"`{name}`"] for name in table.columns]
    given = table[f"`{vector}`"]
    rows = durable(
        table.where(_finite(given) & (F.size(given) > 0)).select(
            F.struct(F.lit(0).alias("_"), *columns).alias("kept_columns"), _whole_numbers(given).alias("x")
        )
    )
    sizes = sorted(row[0] for row in rows.select(F.size("x")).distinct().collect())
    parts = [_of_one_size(rows.where(F.size("x") == size), size, components) for size in sizes]
    if not parts:
        kinds = "n bigint, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
        nothing = [F.lit(None).cast(kind).alias(name) for name, kind in (pair.split(" ") for pair in kinds.split(", "))]
        return rows.where(F.lit(False)).select("kept_columns", *nothing)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def whitening_report(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per usable vector and component; a deviation beyond a long is null."""
    found = whiten(table.select(f"`{vec_id}`", f"`{vector}`"), vector)
    pairs = F.posexplode(F.arrays_zip("whitened", "explained"))
    return found.select(
        F.col(f"kept_columns.`{vec_id}`").alias("vec_id"), "n", "deviation", "identity_error", pairs.alias("place", "pair")
    ).select(
        "vec_id",
        (F.col("place") + 1).cast("int").alias("component"),
        "n",
        F.col("deviation").try_cast("long").alias("deviation"),
        F.col("pair.whitened").alias("whitened"),
        F.col("pair.explained").alias("explained"),
        "identity_error",
    )
