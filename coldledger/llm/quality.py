"""Document quality by Bradley-Terry ranking.

From labelled documents, pairs of a good and a bad one are drawn. Weights are learned so that the
good one of each pair scores higher: logistic loss on the difference of their features. A document
is accepted when its score is above a quantile of the training scores, the one that as many lie
below as are labelled bad.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from .arrays import batchwise, byte_view, free_name, slices
from .labelled import logistic, remainder, training_rows
from .shingles import mixed, word_hashes

#: Labelled documents to learn from, and pairs drawn of them, at most.
TRAINING_ROWS = 20_000
TRAINING_PAIRS = 100_000
RIDGE = 1e-4
#: Labels of ids whose remainder by DIVISOR is HELD_OUT are never learned from.
DIVISOR, HELD_OUT = 3, 1
SEED = 20240606

_KIND = np.full(256, 5, np.int64)
_KIND[ord("a") : ord("z") + 1] = 0
_KIND[ord("A") : ord("Z") + 1] = 1
_KIND[ord("0") : ord("9") + 1] = 2
_KIND[[ord(" "), 9, 11, 12, 13]] = 3
_KIND[10] = 4
_KIND[128:] = 0
_MARKS = [c for c in range(33, 127) if not chr(c).isalnum()]
for _place, _mark in enumerate(_MARKS):
    _KIND[_mark] = 6 + _place
_KINDS = 6 + len(_MARKS)


def _distinct(values: np.ndarray, texts: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct values of each text, and the greatest number of times one occurs."""
    order = np.lexsort((values, texts))
    v, t = values[order], texts[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (t[1:] != t[:-1])
    firsts = np.flatnonzero(new)
    runs = np.diff(np.append(firsts, len(v)))
    most = np.zeros(count, np.int64)
    np.maximum.at(most, t[firsts], runs)
    return np.bincount(t[new], minlength=count), most


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of numbers for each text: what its letters are, how long its words are, how much repeats.
    An empty text has zeros but for the numbers that stand for its emptiness."""
    count = len(offsets) - 1
    sizes = np.diff(offsets)
    texts = np.repeat(np.arange(count), sizes)
    kinds = np.bincount(texts * _KINDS + _KIND[data], minlength=count * _KINDS).reshape(count, _KINDS)
    share = kinds / np.maximum(sizes, 1)[:, None]
    hashes, firsts = word_hashes(data, offsets)
    words = np.diff(firsts)
    owner = np.repeat(np.arange(count), words)
    per_word = np.maximum(words, 1)
    distinct, most = _distinct(hashes, owner, count)
    pair_owner = owner[:-1][owner[:-1] == owner[1:]] if len(owner) else owner
    same = owner[:-1] == owner[1:] if len(owner) else np.zeros(0, bool)
    pairs = mixed(hashes[:-1] * np.uint64(3) + hashes[1:])[same] if len(owner) else hashes
    distinct_pairs, most_pairs = _distinct(pairs, pair_owner, count)
    repeats = np.bincount(pair_owner[(hashes[:-1] == hashes[1:])[same]], minlength=count) if len(owner) else words * 0
    letters = kinds[:, :2].sum(axis=1)
    columns = [
        share,
        np.sqrt(share),
        np.log1p(sizes)[:, None] / 10,
        np.log1p(words)[:, None] / 10,
        (words < 5)[:, None],
        (words < 20)[:, None],
        np.minimum(sizes / per_word, 40)[:, None] / 10,
        (distinct / per_word)[:, None],
        (most / per_word)[:, None],
        (distinct_pairs / np.maximum(words - 1, 1))[:, None],
        (most_pairs / per_word)[:, None],
        (repeats / per_word)[:, None],
        (kinds[:, 1] / np.maximum(letters, 1))[:, None],
        (kinds[:, 1] > 0.5 * letters)[:, None],
        (letters / np.maximum(sizes, 1))[:, None],
    ]
    return np.hstack([np.asarray(c, np.float64) for c in columns])


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.strength(x) - self.threshold, -500, 500)))


@dataclass(frozen=True)
class _Gaps:
    """Feature differences of pairs of rows, made a slice at a time."""

    x: np.ndarray
    better: np.ndarray
    worse: np.ndarray

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.better), self.x.shape[1]

    def __getitem__(self, rows: slice) -> np.ndarray:
        return self.x[self.better[rows]] - self.x[self.worse[rows]]


def fit_pairs(x: np.ndarray, good: np.ndarray, most_pairs: int = TRAINING_PAIRS, seed: int = SEED) -> QualityModel:
    """Learn from rows of features and whether each is good. If all are alike every score is the same."""
    if not len(x):
        x = np.zeros((1, 1))
        return QualityModel(np.zeros(1), np.ones(1), np.zeros(1), 0.0)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    model = QualityModel(mean, scale, np.zeros(x.shape[1]), 0.0)
    better, worse = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(better) or not len(worse):
        return QualityModel(mean, scale, model.weights, 0.0 if len(better) else 1.0)
    rng = np.random.default_rng(seed)
    scaled = np.clip((x - mean) / scale, -8, 8)
    pairs = min(most_pairs, 4 * len(better) * len(worse))
    gaps = _Gaps(scaled, rng.choice(better, pairs), rng.choice(worse, pairs))
    weights = logistic(gaps, np.ones(pairs), RIDGE, intercept=False)
    strength = np.sort(scaled @ weights)
    # The quantile that as many lie below as are bad, between its two neighbours.
    cut = len(worse)
    return QualityModel(mean, scale, weights, float((strength[cut - 1] + strength[min(cut, len(strength) - 1)]) / 2))


def _with_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            x = features(*byte_view(batch.column("text")))
            rows = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("label"), rows], ["label", "x"])


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> QualityModel:
    """Learn from a sample of at most TRAINING_ROWS labelled documents."""
    ship_package(docs.sparkSession)
    plain = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = training_rows(plain, labels, "quality", TRAINING_ROWS, DIVISOR, HELD_OUT)
    found = rows.select("label", "text").transform(batchwise, _with_features, "label int, x array<double>").toArrow()
    if not found.num_rows:
        return fit_pairs(np.zeros((0, 1)), np.zeros(0, bool))
    label = found["label"].to_numpy()
    x = pa.concat_arrays(found["x"].chunks).flatten().to_numpy().reshape(len(label), -1)
    order = np.lexsort((label, *x.T[::-1]))  # the order of tasks must not matter
    return fit_pairs(x[order], label[order] == 1)


def _scored(batches: Iterator[pa.RecordBatch], model: QualityModel, text: str, score: str) -> Iterator[pa.RecordBatch]:
    blank = len(model.weights) == 1
    for whole in batches:
        for batch in slices(whole, text):
            x = features(*byte_view(batch.column(text)))
            yield batch.append_column(score, pa.array(model.score(x[:, :1] * 0 if blank else x)))


def with_quality(docs: DataFrame, model: QualityModel, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` and the score of each text, from 0 to 1; a null text is empty, and empty texts are scored too."""
    ship_package(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())])
    return docs.transform(batchwise, lambda batches: _scored(batches, model, text, score), schema)


def quality_report(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of each document."""
    plain = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    scored = with_quality(plain, train(plain, labels))
    return scored.select(
        "doc_id",
        F.coalesce(remainder("doc_id", DIVISOR) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is accepted, with all their columns."""
    score = free_name(docs, "quality_score")
    scored = with_quality(docs, train(docs, labels, doc_id, text), text, score)
    return scored.where(F.col(score) >= 0.5).select(*[f"`{name}`" for name in docs.columns])
