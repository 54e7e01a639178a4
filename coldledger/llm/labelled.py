"""Bounded samples of labelled rows, to fit classifiers on."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable

#: Rows of a regression that are worked on at a time, to bound the driver's memory.
BLOCK_ROWS = 8192


def remainder(key: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``."""
    return F.pmod(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")), F.lit(divisor))


def training_rows(
    docs: DataFrame, labels: DataFrame, target: str, most_rows: int, divisor: int, held_out: int, doc_id: str = "doc_id"
) -> DataFrame:
    """``docs`` with their ``label``, of at most ``most_rows`` labelled ids whose remainder is not ``held_out``.

    The ids are the ones with the lowest hashes. Ids with a null label or with different labels are
    left out. The sample is small by its bound, so it is staged and broadcast.
    """
    usable = (
        labels.select(F.col(doc_id).cast("long").alias("label_id"), F.col(target).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & F.col("label_id").isNotNull())
        .where(remainder("label_id", divisor) != held_out)
        .groupBy("label_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("highest"))
        .where("label = highest")
        .select("label_id", "label")
    )
    known = durable(usable.orderBy(F.xxhash64("label_id"), "label_id").limit(most_rows))
    return docs.join(F.broadcast(known), F.col(f"`{doc_id}`").cast("long") == F.col("label_id")).drop("label_id")


class Rows(Protocol):
    """A matrix of which a slice of rows is made when it is asked for."""

    shape: tuple[int, int]

    def __getitem__(self, rows: slice) -> np.ndarray: ...


def logistic(
    x: np.ndarray | Rows, y: np.ndarray, ridge: float, intercept: bool, rounds: int = 40
) -> np.ndarray:
    """Weights of a ridge logistic regression on soft labels ``y``, by damped Newton steps.

    Rows are worked on BLOCK_ROWS at a time, so no second copy of ``x`` is held.
    """
    count, width = x.shape[0], x.shape[1] + intercept
    penalty = np.full(width, ridge * count)
    if intercept:
        penalty[-1] = 1e-9 * count

    def blocks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for start in range(0, count, BLOCK_ROWS):
            rows = x[start : start + BLOCK_ROWS]
            yield np.hstack([rows, np.ones((len(rows), 1))]) if intercept else rows, y[start : start + BLOCK_ROWS]

    def loss(w: np.ndarray) -> float:
        total = 0.5 * (penalty * w * w).sum()
        for rows, wanted in blocks():
            z = rows @ w
            total += (np.logaddexp(0, z) - wanted * z).sum()
        return float(total)

    w = np.zeros(width)
    value = loss(w)
    for _ in range(rounds):
        slope, bend = penalty * w, np.diag(penalty + 1e-9)
        for rows, wanted in blocks():
            p = 1 / (1 + np.exp(-np.clip(rows @ w, -500, 500)))
            slope += rows.T @ (p - wanted)
            bend += (rows * (p * (1 - p))[:, None]).T @ rows
        step = np.linalg.solve(bend, slope)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > value:
            size /= 2
        w, before = w - size * step, value
        value = loss(w)
        if before - value <= 1e-9 * abs(before):
            break
    return w
