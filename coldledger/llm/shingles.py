"""Sets of word shingles as sorted arrays of 64-bit hashes, for many texts at once."""

from __future__ import annotations

import hashlib

import numpy as np

_RNG = np.random.default_rng(20240411)
_LETTER = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x5851F42D4C957F2D
_BASE_BACK = pow(_BASE, -1, 2**64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _powers(base: int, count: int) -> np.ndarray:
    powers = np.full(count, base, np.uint64)
    powers[:1] = 1
    return np.cumprod(powers, dtype=np.uint64)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, A-Z lower-cased, and for each text the number of words before it (n + 1 numbers).

    A word's hash is the sum of a random number per byte times a power of the byte's place.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    data = _LOWER[data]
    inside = ~_BLANK[data]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    starts = np.flatnonzero(inside & (border[:-1] | ~np.concatenate([[False], inside[:-1]])))
    stops = np.flatnonzero(inside & (border[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTER[data] * _powers(_BASE, len(data)), dtype=np.uint64)])
    back = _powers(_BASE_BACK, len(data))
    hashes = (sums[stops] - sums[starts]) * back[starts] + (stops - starts).astype(np.uint64)
    return mixed(hashes), np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts one after another, and n + 1 offsets.

    A shingle is ``words`` words; a text with fewer words but one at least has all its words as one.
    """
    hashes, firsts = word_hashes(data, offsets)
    counts = np.diff(firsts)
    texts = np.repeat(np.arange(len(counts)), np.maximum(counts - words + 1, (counts > 0).astype(np.int64)))
    if not len(texts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    shingles_of = np.maximum(counts - words + 1, (counts > 0).astype(np.int64))
    before = np.cumsum(shingles_of) - shingles_of
    place = firsts[texts] + np.arange(len(texts)) - before[texts]
    value = np.zeros(len(texts), np.uint64)
    for step in range(words):
        there = step < counts[texts]
        value[there] = mixed(value[there] * np.uint64(0x9E3779B97F4A7C15) + hashes[place[there] + step])
    order = np.lexsort((value, texts))
    value = value[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (texts[1:] != texts[:-1])
    return value[new], np.searchsorted(texts[new], np.arange(len(offsets)))


def fingerprint(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def intersection_size(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    place = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[place] == a).sum())
