"""Content-defined chunks: borders depend on the bytes just before them, so equal passages
are cut alike wherever they stand."""

from __future__ import annotations

import numpy as np

#: A border depends on so many bytes before it.
WINDOW = 32
#: Rolling hashes are computed over blocks of so many bytes, which bounds the memory of a long text.
BLOCK = 1 << 20
_GEAR = np.random.default_rng(20240229).integers(0, 2**32, 256, dtype=np.uint32)


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """For each byte, the sum over the last ``WINDOW`` bytes of a random number per byte value,
    shifted left by the distance; built by doubling the width."""
    state = _GEAR[data]
    width = 1
    while width < WINDOW:
        wider = state.copy()
        wider[width:] += state[:-width] << np.uint32(width)
        state = wider
        width *= 2
    return state


def _candidates(data: np.ndarray, bits: int) -> np.ndarray:
    found = []
    for start in range(0, len(data), BLOCK):
        first = max(0, start - WINDOW + 1)
        state = rolling_hash(data[first : start + BLOCK])[start - first :]
        found.append(np.flatnonzero(state >> np.uint32(32 - bits) == 0) + start + 1)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def chunk_ends(
    data: np.ndarray, offsets: np.ndarray, bits: int = 10, longest: int = 1 << 16
) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all chunks of texts that lie one after another in ``data``, and the text each belongs to.

    Chunks have 2 ** ``bits`` bytes on average and ``longest`` (and three more) at most. No chunk
    ends inside a UTF-8 character. Empty texts have no chunk.
    """
    starts, stops = offsets[:-1], offsets[1:]
    cuts = _candidates(data, bits)
    owner = np.searchsorted(stops, cuts, side="left")
    # A window that reaches into the text before says nothing about this text.
    cuts = cuts[cuts - starts[np.minimum(owner, len(starts) - 1)] >= WINDOW] if len(starts) else cuts
    cuts = np.union1d(cuts, stops[stops > starts])
    owner = np.searchsorted(stops, cuts, side="left")
    begins = np.maximum(np.concatenate([[0], cuts[:-1]]).astype(np.int64), starts[owner]) if len(cuts) else cuts
    extra = (cuts - begins - 1) // longest if len(cuts) else cuts
    if len(cuts) and extra.any():
        step = np.concatenate([np.arange(1, n + 1) for n in extra if n]) * longest
        cuts = np.union1d(cuts, np.repeat(begins, extra) + step)
    for _ in range(3):
        inside = cuts < len(data)
        inside[inside] = (data[cuts[inside]] & 0xC0) == 0x80
        cuts = cuts + inside
    cuts = np.unique(cuts)
    return cuts, np.searchsorted(stops, cuts, side="left")
