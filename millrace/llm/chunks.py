"""Content-defined chunking: cuts where a gear rolling hash of the last 32 bytes says so."""

from __future__ import annotations

import numpy as np

from millrace.llm.batches import mix

REACH = 32
GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash at every byte: the sum of GEAR[byte] << distance over the last 32 bytes, built by doubling the reach."""
    hashed = GEAR[data]
    reach = 1
    while reach < REACH:
        longer = hashed.copy()
        longer[reach:] += hashed[:-reach] << np.uint32(reach)
        hashed, reach = longer, reach * 2
    return hashed


def cuts(data: np.ndarray, offsets: np.ndarray, bits: int) -> np.ndarray:
    """Sorted positions where a chunk begins: all row starts, and each position after a byte whose hash has ``bits``
    high zeros and lies wholly in its row. Chunks average 2**bits bytes, and a cut depends on 32 bytes only, so an
    insertion moves no cut further away."""
    marked = np.flatnonzero(gear(data) >> np.uint32(32 - bits) == 0) + 1
    row = np.searchsorted(offsets, marked - 1, side="right") - 1
    marked = marked[(marked - offsets[row] >= REACH) & (marked < offsets[row + 1])] if len(marked) else marked
    return np.union1d(offsets[:-1][np.diff(offsets) > 0], marked)
