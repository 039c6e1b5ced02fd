"""Work on the bytes of many texts at once: slices of Arrow batches, words, hashes of spans.

Everything here runs inside a task on one slice of bounded size and keeps nothing between
calls. Hashes are the same in every process: their tables come from a fixed integer mixer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

SLICE_BYTES = 1 << 20
SHORT = 64
_BLOCK = 1 << 16

# bytes that are not white space: [^\x20\x09-\x0D]
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
# digits, small letters and everything beyond ASCII: [^\x00-\x2F\x3A-\x60\x7B-\x7F]
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def bounded(spark: SparkSession) -> None:
    """Keeps Arrow batches small, as a few long texts would otherwise fill a worker's and its executor's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int) -> np.ndarray:
    steps = np.full(_BLOCK + 1, base, dtype=np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


@cache
def _tables(seed: int) -> tuple[np.ndarray, int, int, np.ndarray, np.ndarray]:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    base = int(mix(np.array([seed + 977], dtype=np.uint64))[0]) | 1
    base = base if base % 8 in (3, 5) else base ^ 4  # of largest order modulo 2**64
    inverse = pow(base, -1, 1 << 64)
    return values, base, inverse, _powers(base), _powers(inverse)


def _prefixes(data: np.ndarray, at: np.ndarray, seed: int) -> np.ndarray:
    """Polynomial sums of data[:p] for the sorted positions p."""
    values, base, _, powers, _ = _tables(seed)
    out = np.empty(len(at), dtype=np.uint64)
    carry, shift, done = np.uint64(0), 1, 0
    for first in range(0, len(data) + 1, _BLOCK):
        part = data[first : first + _BLOCK]
        sums = np.empty(len(part) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(values[part] * powers[: len(part)], out=sums[1:])
        sums = sums * np.uint64(shift) + carry
        upto = np.searchsorted(at, first + _BLOCK) if first + _BLOCK <= len(data) else len(at)
        out[done:upto] = sums[at[done:upto] - first]
        done, carry, shift = upto, sums[-1], shift * pow(base, _BLOCK, 1 << 64) % (1 << 64)
    return out


def sum_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of data[s:e] at a cost that does not depend on their length; both lists of positions must be in
    order. They are polynomial sums, whose collisions can be built from 1,024 bytes on: for shorter spans only."""
    _, _, inverse, _, back = _tables(seed)
    sums = _prefixes(data, ends, seed) - _prefixes(data, starts, seed)
    block = starts >> 16
    firsts, place = np.unique(block, return_inverse=True)
    far = np.array([pow(inverse, int(b) << 16, 1 << 64) for b in firsts], dtype=np.uint64)
    sums = sums * back[starts & (_BLOCK - 1)] * (far[place] if len(far) else np.uint64(1))
    return mix(sums + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of data[s:e]. Spans up to SHORT bytes are mixed eight bytes at a time, which keeps spans of one
    length up to eight bytes apart for certain; of longer ones a keyed BLAKE2 digest is taken."""
    lengths = ends - starts
    start = np.uint64((seed * 0x9E3779B97F4A7C15 + 1) % (1 << 64))
    hashed = mix(lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + start)
    lanes = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, dtype=np.uint8)]), 8)
    for first in range(0, len(starts), _BLOCK):
        part = slice(first, first + _BLOCK)
        at, left, out = starts[part], lengths[part], hashed[part]
        open_ = np.flatnonzero((left > 0) & (left <= SHORT))
        for lane in range(0, SHORT, 8):
            open_ = open_[left[open_] > lane]
            if not len(open_):
                break
            held = np.ascontiguousarray(lanes[at[open_] + lane]).view("<u8")[:, 0]
            spare = np.maximum(8 - (left[open_] - lane), 0).astype(np.uint64) * np.uint64(8)
            held = held & (np.uint64(0xFFFFFFFFFFFFFFFF) >> spare)
            out[open_] = mix((out[open_] ^ held) * np.uint64(0xA24BAED4963EE407) + np.uint64(lane + 1))
    key = seed.to_bytes(8, "little")
    for i in np.flatnonzero(lengths > SHORT).tolist():
        hashed[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8, key=key).digest(), "little")
    return hashed


def window_hashes(data: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hashes of data[i:i + width] for every i at which that many bytes are left."""
    n = len(data) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    values, _, _, powers, back = _tables(seed)
    out = np.empty(n, dtype=np.uint64)
    step = _BLOCK - width
    for first in range(0, n, step):
        part = data[first : first + _BLOCK]
        k = min(step, n - first)
        sums = np.empty(len(part) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(values[part] * powers[: len(part)], out=sums[1:])
        out[first : first + k] = (sums[width : width + k] - sums[:k]) * back[:k]
    return mix(out)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column one after another, and where each row begins and ends; null is empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    held = column.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8)[first:last] if held is not None and last > first else np.empty(0, dtype=np.uint8)
    return data, offsets - first


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces whose texts hold about ``most`` bytes; a longer text is a piece of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(utf8(batch.column(batch.schema.get_field_index(column)))[1])
        piece = (np.cumsum(sizes) - sizes) // most
        cuts = np.flatnonzero(np.diff(piece)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(int(a), int(b - a))
    pa.default_memory_pool().release_unused()


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes of a kind; no run goes on into the next row."""
    held = inside[data]
    begin = held.copy()
    begin[1:] &= ~held[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begin[edges] = held[edges]
    finish = held.copy()
    finish[:-1] &= ~held[1:]
    lasts = offsets[1:][offsets[1:] > 0] - 1
    finish[lasts] = held[lasts]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of each row's bytes are marked."""
    sums = np.zeros(len(mask) + 1, dtype=np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the marked stretches."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2]


def covered(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Marks the positions that lie in any of the spans."""
    depth = np.bincount(starts, minlength=size + 1) - np.bincount(ends, minlength=size + 1)
    return np.cumsum(depth[:size]) > 0


def replaced(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """The batch with some columns in place of those of the same name."""
    return pa.RecordBatch.from_arrays([columns.get(f.name, batch.column(i)).cast(f.type) for i, f in enumerate(batch.schema)], schema=batch.schema)
