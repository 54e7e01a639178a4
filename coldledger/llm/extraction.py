"""Main text of web pages by a linear-chain conditional random field.

A page is its sequence of leaf blocks. Features of a block are the tags and the names above it and
the shape of its text; the chain ties neighbours together. The field is trained on labelled pages
and the most probable labels of a page are found by Viterbi's algorithm.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .arrays import batchwise, slices, texts_of
from .blocks import Block, leaf_blocks
from .training_pages import labelled_pages

#: Pages that the field is trained on, and steps of the training.
TRAINING_PAGES = 500
STEPS = 150
SEED = 7
RIDGE = 0.02


def block_features(block: Block) -> list[str]:
    text, words = block.text, block.text.count(" ") + 1
    found = ["bias", f"words={min(words, 64).bit_length()}"]
    found += [f"in={tag}" for tag in set(block.tags)]
    found += [f"name={name}" for name in block.names]
    found.append(f"leaf={block.tags[-1] if block.tags else ''}")
    found.append(f"links={round(4 * min(1.0, block.link_chars / len(text)))}")
    found.append(f"ends={text[-1] if text[-1] in '.?!:' else 'open'}")
    found.append(f"depth={min(len(block.tags), 8)}")
    if "©" in text or "copyright" in text.lower():
        found.append("rights")
    return found


@dataclass(frozen=True)
class Field:
    """Weights of each feature for both labels, and of each pair of neighbouring labels."""

    place: dict[str, int]
    weights: np.ndarray
    steps: np.ndarray

    def scores(self, blocks: Sequence[Block]) -> np.ndarray:
        place = self.place
        return np.array(
            [self.weights[[place[f] for f in block_features(b) if f in place]].sum(axis=0) for b in blocks]
        ).reshape(len(blocks), 2)

    def labels(self, blocks: Sequence[Block]) -> list[int]:
        """The most probable labels of all blocks together."""
        if not blocks:
            return []
        scores = self.scores(blocks)
        best, back = scores[0], []
        for own in scores[1:]:
            ways = best[:, None] + self.steps
            back.append(ways.argmax(axis=0))
            best = ways.max(axis=0) + own
        label = int(best.argmax())
        path = [label]
        for choice in reversed(back):
            label = int(choice[label])
            path.append(label)
        return path[::-1]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def train_field(pages: Sequence[tuple[list[Block], list[int]]], steps: int = STEPS) -> Field:
    """Maximise the probability of the labels by gradient steps with adaptive sizes (Adam)."""
    place: dict[str, int] = {}
    features, owners, labels, starts = [], [], [], [0]
    for blocks, known in pages:
        for block, label in zip(blocks, known):
            for name in block_features(block):
                features.append(place.setdefault(name, len(place)))
                owners.append(len(labels))
            labels.append(label)
        starts.append(len(labels))
    feature, owner, label = np.array(features), np.array(owners), np.array(labels)
    count, longest = len(pages), max(np.diff(starts))
    # Blocks of all pages side by side: place of block t of page n, or -1.
    grid = np.full((count, longest), -1)
    for n in range(count):
        grid[n, : starts[n + 1] - starts[n]] = np.arange(starts[n], starts[n + 1])
    there = grid >= 0
    gold = np.eye(2)[label]
    follows = there[:, 1:]
    gold_steps = np.zeros((2, 2))
    np.add.at(gold_steps, (label[grid[:, :-1][follows]], label[grid[:, 1:][follows]]), 1)
    parameters = np.zeros(2 * len(place) + 4)
    first, second = np.zeros_like(parameters), np.zeros_like(parameters)
    for turn in range(1, steps + 1):
        weights, moves = parameters[:-4].reshape(-1, 2), parameters[-4:].reshape(2, 2)
        scores = np.stack([np.bincount(owner, weights[feature, k], minlength=len(label)) for k in (0, 1)], axis=1)
        padded = np.where(there[:, :, None], scores[grid], 0.0)
        ahead = np.zeros((count, longest, 2))
        behind = np.zeros((count, longest, 2))
        ahead[:, 0] = padded[:, 0]
        for t in range(1, longest):
            step = _logsum(ahead[:, t - 1, :, None] + moves, 1) + padded[:, t]
            ahead[:, t] = np.where(there[:, t, None], step, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            step = _logsum(moves + (padded[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[:, t] = np.where(there[:, t + 1, None], step, 0.0)
        total = _logsum(ahead[:, -1], 1)
        own = np.exp(ahead + behind - total[:, None, None])[there]
        both = (
            ahead[:, :-1, :, None] + moves + (padded[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]
        )
        expected = np.exp(both[follows]).sum(axis=0)
        rest = gold - own
        slope = np.concatenate(
            [
                np.stack([np.bincount(feature, rest[owner, k], minlength=len(place)) for k in (0, 1)], axis=1).ravel(),
                (gold_steps - expected).ravel(),
            ]
        )
        slope -= RIDGE * parameters
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        parameters = parameters + 0.1 * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.99**turn)) + 1e-9)
    return Field(place, parameters[:-4].reshape(-1, 2), parameters[-4:].reshape(2, 2))


def matched_labels(page: str, known: list[tuple[str, int]]) -> tuple[list[Block], list[int]]:
    """The blocks of a labelled page with their labels, found by their text in order."""
    blocks, labels, place = leaf_blocks(page), [], 0
    plain = [(" ".join(text.replace("&copy;", "©").split()), label) for text, label in known]
    for block in blocks:
        while place < len(plain) - 1 and plain[place][0] not in block.text:
            place += 1
        labels.append(plain[place][1])
        place = min(place + 1, len(plain) - 1)
    return blocks, labels


@lru_cache(maxsize=4)
def trained_field(pages: int = TRAINING_PAGES, seed: int = SEED) -> Field:
    made = [matched_labels(page, known) for page, known in labelled_pages(pages, seed)]
    return train_field([item for item in made if item[0]])


def main_text(page: str, field: Field) -> str:
    blocks = leaf_blocks(page)
    return "\n".join(block.text for block, label in zip(blocks, field.labels(blocks)) if label)


def _extracted(batches: Iterator[pa.RecordBatch], field: Field) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "html"):
            texts = [main_text(page, field) for page in texts_of(batch.column("html"))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array([len(text) for text in texts], pa.int64()),
                ],
                ["page_id", "url", "text", "n_chars"],
            )


def extract_text(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", field: Field | None = None
) -> DataFrame:
    """page_id, url, text and n_chars of each page; the text of a null, empty or blockless page is empty.

    Each page stands for itself, so repeated pages give repeated rows.
    """
    ship_package(pages.sparkSession)
    used = field or trained_field()
    plain = pages.select(
        F.col(f"`{page_id}`").cast("long").alias("page_id"),
        F.col(f"`{url}`").cast("string").alias("url"),
        F.col(f"`{html}`").cast("string").alias("html"),
    )
    return plain.transform(
        batchwise,
        lambda batches: _extracted(batches, used), "page_id bigint, url string, text string, n_chars bigint"
    )
