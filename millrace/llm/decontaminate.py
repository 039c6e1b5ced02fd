"""Benchmark decontamination by an FM-index over the words of each training shard."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import ALNUM, LOWER, covered, replaced, runs, slices, span_hashes, utf8, words
from millrace.session import stage

WINDOW = 10
BLOCK_WORDS = 1_000_000
SAMPLED = 8


class BitRank:
    """Bits with the number of ones before any position."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.packed = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.packed), dtype=np.int64)[:-1]])

    def ones(self, at: np.ndarray) -> np.ndarray:
        block, low = at >> 6, (at & 63).astype(np.uint64)
        return self.before[block] + np.bitwise_count(self.packed[block] & ((np.uint64(1) << low) - np.uint64(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.packed[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


class WaveletMatrix:
    """Ranks of any symbol in a sequence, one bit level at a time."""

    def __init__(self, symbols: np.ndarray, largest: int):
        self.levels = []
        for shift in range(max(1, int(largest).bit_length()) - 1, -1, -1):
            bits = (symbols >> shift) & 1 == 1
            self.levels.append((shift, BitRank(bits), len(symbols) - int(bits.sum())))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])

    def place(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position ``at`` lands after all levels if only ``symbol`` is followed."""
        for shift, bits, zeros in self.levels:
            ones = bits.ones(at)
            at = np.where((symbol >> shift) & 1 == 1, zeros + ones, at - ones)
        return at

    def read(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at some positions, and where these land."""
        symbol = np.zeros(len(at), dtype=np.int64)
        for shift, bits, zeros in self.levels:
            one, ones = bits.get(at), bits.ones(at)
            symbol |= one.astype(np.int64) << shift
            at = np.where(one, zeros + ones, at - ones)
        return symbol, at


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order. Zeros end runs: each sorts before all else and differs from the others by
    position, so no comparison goes on past a run. Only suffixes that still tie are sorted again, by twice the length."""
    n, ends = len(symbols), symbols == 0
    group = np.where(ends, np.cumsum(ends) - 1, int(ends.sum()) + symbols)
    order = np.argsort(group, kind="stable")
    head = np.concatenate([[True], group[order][1:] != group[order][:-1]])
    first = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = first
    alone = head & np.concatenate([head[1:], [True]])
    active, k = order[~alone], 1
    while len(active):
        key = rank[active] * (n + 1) + rank[active + k]
        by = np.argsort(key, kind="stable")
        active, key = active[by], key[by]
        old = rank[active]
        at = np.arange(len(active))
        group_head = np.concatenate([[True], old[1:] != old[:-1]])
        head = np.concatenate([[True], key[1:] != key[:-1]])
        rank[active] = old + np.maximum.accumulate(np.where(head, at, 0)) - np.maximum.accumulate(np.where(group_head, at, 0))
        active = active[~(head & np.concatenate([head[1:], [True]]))]
        k *= 2
    out = np.empty(n, dtype=np.int64)
    out[rank] = np.arange(n)
    return out


class FMIndex:
    """Counts and finds phrases in runs of symbols from 1; every run must end with a 0.

    Phrases are searched backwards through ranks in the Burrows-Wheeler transform, all at once. Positions
    are kept for every eighth symbol and for the starts of runs; others are found by stepping to the left.
    """

    def __init__(self, symbols: np.ndarray):
        order = suffix_order(symbols)
        before = symbols[order - 1]
        self.size, self.largest = len(symbols), int(symbols.max(initial=0))
        self.transform = WaveletMatrix(before, self.largest)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=self.largest + 1))])
        kept = (order % SAMPLED == 0) | (before == 0)
        self.sampled, self.positions = BitRank(kept), order[kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of suffixes that begin with each phrase (rows of symbols, filled up on the right)."""
        low, high = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.size, dtype=np.int64)
        high[(phrases * (np.arange(phrases.shape[1]) < lengths[:, None])).max(axis=1, initial=0) > self.largest] = 0
        for step in range(1, int(lengths.max(initial=0)) + 1):
            at = np.flatnonzero((lengths >= step) & (low < high))
            symbol = phrases[at, lengths[at] - step]
            start = self.transform.place(symbol, np.zeros(len(at), dtype=np.int64))
            low[at] = self.first[symbol] + self.transform.place(symbol, low[at]) - start
            high[at] = self.first[symbol] + self.transform.place(symbol, high[at]) - start
        return low, np.maximum(low, high)

    def locate(self, at: np.ndarray) -> np.ndarray:
        """The positions of some suffixes."""
        out, todo, steps = np.empty(len(at), dtype=np.int64), np.arange(len(at)), 0
        while len(todo):
            known = self.sampled.get(at)
            out[todo[known]] = self.positions[self.sampled.ones(at[known])] + steps
            todo, at, steps = todo[~known], at[~known], steps + 1
            symbol, place = self.transform.read(at)
            at = self.first[symbol] + place - self.transform.place(symbol, np.zeros(len(at), dtype=np.int64))
        return out


@dataclass(frozen=True)
class Phrases:
    """A block of the test set: its word hashes in order, distinct windows as rows of symbols (a word's place
    from 1), their lengths, and for each window the items it comes from."""

    vocabulary: np.ndarray
    windows: np.ndarray
    lengths: np.ndarray
    starts: np.ndarray
    items: np.ndarray
    names: list[str]


def phrases(rows: list[tuple[str | None, str | None]]) -> Phrases:
    """Windows of ten words of each text, or all words of a shorter one; an item without an id names nobody."""
    data, offsets = utf8(pa.array([t for _, t in rows], type=pa.string()))
    data = LOWER[data]
    begin, end, row = words(data, offsets, ALNUM)
    hashes = span_hashes(data, begin, end)
    vocabulary = np.unique(hashes)
    symbols = np.searchsorted(vocabulary, hashes) + 1
    counts = np.bincount(row, minlength=len(rows))
    length = np.minimum(counts, WINDOW)[row]
    at = np.arange(len(row))
    last = np.cumsum(counts)[row] if len(row) else at
    whole = at + length <= last
    at, length, owner = at[whole], length[whole], row[whole]
    cells = at[:, None] + np.arange(WINDOW)
    windows = np.where(np.arange(WINDOW) < length[:, None], symbols[np.minimum(cells, max(0, len(symbols) - 1))], 0) if len(at) else np.zeros((0, WINDOW), dtype=np.int64)
    windows, which = np.unique(windows, axis=0, return_inverse=True)
    which = which.reshape(-1)
    names = sorted({str(i) for i, _ in rows if i is not None})
    place = {n: i for i, n in enumerate(names)}
    item = np.array([place.get(str(rows[o][0]), -1) if rows[o][0] is not None else -1 for o in owner], dtype=np.int64)
    by = np.argsort(which, kind="stable")
    return Phrases(vocabulary, windows, (windows > 0).sum(axis=1), np.searchsorted(which[by], np.arange(len(windows) + 1)), item[by], names)


def _pieces(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Items of more than ``most`` windows become several of that many, with nine words in common with the next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = utf8(batch.column("text"))
            begin, end, row = words(LOWER[data], offsets, ALNUM)
            counts = np.bincount(row, minlength=batch.num_rows)
            firsts = np.cumsum(counts) - counts
            for i, item in enumerate(batch.column("item").to_pylist()):
                starts = range(0, max(1, int(counts[i]) - WINDOW + 1), most)
                for at in starts:
                    if len(starts) == 1:
                        text = bytes(data[offsets[i] : offsets[i + 1]])
                    else:
                        first, last = firsts[i] + at, firsts[i] + min(at + most + WINDOW - 1, counts[i]) - 1
                        text = bytes(data[begin[first] : end[last]])
                    yield pa.RecordBatch.from_arrays([pa.array([item], pa.string()), pa.array([text.decode()], pa.string())], names=["item", "text"])

    return run


def blocks(benchmark: DataFrame, item: str, text: str, most: int = BLOCK_WORDS) -> Iterator[Phrases]:
    """The test set in blocks of bounded size, each small enough to go to every task, made one at a time. A block ends
    after the piece with which it reaches ``most`` characters times eight; tasks cut longer items into pieces, so only
    a single word can be larger than that."""
    held, size = [], 0
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
    for row in rows.mapInArrow(_pieces(most), "item string, text string").toLocalIterator():
        held.append((row[0], row[1]))
        size += len(row[1] or "")
        if size >= 8 * most:
            yield phrases(held)
            held, size = [], 0
    if held:
        yield phrases(held)


def find(data: np.ndarray, begin: np.ndarray, end: np.ndarray, row: np.ndarray, block: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last word (exclusive) of every occurrence of a window in the words of a shard, as lists of
    occurrences with (row, item) pairs beside them. Words that the block doesn't know cannot be part of an
    occurrence, so only runs of known words that can hold a window are indexed."""
    none = np.empty(0, dtype=np.int64)
    if not len(block.windows) or not len(row):
        return none, none, none, none
    hashes = span_hashes(data, begin, end)
    symbols = np.searchsorted(block.vocabulary, hashes)
    known = block.vocabulary[np.minimum(symbols, len(block.vocabulary) - 1)] == hashes
    new = np.concatenate([[True], (row[1:] != row[:-1]) | ~known[:-1]])
    heads = np.flatnonzero(known & new)
    stops = np.flatnonzero(known & np.concatenate([~known[1:] | (row[1:] != row[:-1]), [True]])) + 1
    fit = stops - heads >= block.lengths.min()
    heads, stops = heads[fit], stops[fit]
    if not len(heads):
        return none, none, none, none
    sizes = stops - heads + 1
    starts = np.cumsum(sizes) - sizes
    at = np.arange(sizes.sum()) - np.repeat(starts - heads, sizes)
    text = np.where(at < np.repeat(stops, sizes), symbols[np.minimum(at, len(symbols) - 1)] + 1, 0)
    index = FMIndex(text)
    low, high = index.search(block.windows, block.lengths)
    count = high - low
    which = np.repeat(np.arange(len(count)), count)
    suffixes = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - low, count)
    first = at[index.locate(suffixes)]
    seen = np.unique(row[first] * len(block.windows) + which)
    pair_row, pair_window = seen // len(block.windows), seen % len(block.windows)
    per = block.starts[pair_window + 1] - block.starts[pair_window]
    cell = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per - block.starts[pair_window], per)
    named = np.unique(np.repeat(pair_row, per) * (len(block.names) + 1) + block.items[cell] + 1)
    named_row, named_item = named // (len(block.names) + 1), named % (len(block.names) + 1) - 1
    return first, first + block.lengths[which], named_row[named_item >= 0], named_item[named_item >= 0]


def _search(block: Phrases | None, text: str, finish: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None):
    """Adds what a block finds to the columns _words, _spans (word and byte ends of hit stretches) and _items;
    ``finish`` makes the result of the last pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            data, offsets = utf8(batch.column(text))
            data = LOWER[data]
            begin, end, row = words(data, offsets, ALNUM)
            counts = np.bincount(row, minlength=batch.num_rows)
            spans, items = batch.column("_spans").to_pylist(), batch.column("_items").to_pylist()
            if block is not None:
                first, last, named_row, named_item = find(data, begin, end, row, block)
                hit = covered(first, last, len(row))
                hit_from, hit_to = runs(hit)
                # a stretch may go over the edge of a row if both sides are hit
                cut = np.cumsum(counts)[:-1]
                cut = cut[(cut > 0) & (cut < len(row))]
                inner = cut[hit[cut] & hit[cut - 1]] if len(cut) else cut
                hit_from, hit_to = np.union1d(hit_from, inner), np.union1d(hit_to, inner)
                owner, firsts = row[hit_from], (np.cumsum(counts) - counts)
                found = np.stack([hit_from - firsts[owner], hit_to - firsts[owner], begin[hit_from] - offsets[owner], end[hit_to - 1] - offsets[owner]], axis=1).astype(np.int64)
                for r in np.unique(owner):
                    spans[r] = (spans[r] or b"") + found[owner == r].tobytes()
                for r, i in zip(named_row.tolist(), named_item.tolist(), strict=True):
                    items[r] = (items[r] or []) + [block.names[i]]
            done = replaced(batch, _words=pa.array(counts), _spans=pa.array(spans, type=pa.binary()), _items=pa.array(items, type=pa.list_(pa.string())))
            yield finish(done) if finish else done

    return run


def _merged(raw: bytes | None) -> np.ndarray:
    """The stretches of a document from all blocks, those that meet or overlap made one."""
    found = np.frombuffer(raw or b"", dtype=np.int64).reshape(-1, 4)
    found = found[np.argsort(found[:, 0], kind="stable")]
    out: list[list[int]] = []
    for a, b, x, y in found.tolist():
        if out and a <= out[-1][1]:
            out[-1][1], out[-1][3] = max(out[-1][1], b), max(out[-1][3], y)
        else:
            out.append([a, b, x, y])
    return np.array(out, dtype=np.int64).reshape(-1, 4)


def _searched(documents: DataFrame, benchmark: DataFrame, text: str, item: str, phrase: str, finish: Callable[[pa.RecordBatch], pa.RecordBatch], schema) -> DataFrame:
    """One pass for each block of the test set; the last one makes the result. Passes before it are written to the
    shared folder, so that the driver and a task hold one block, however many there are."""
    out = documents.select("*", F.lit(0).cast("long").alias("_words"), F.lit(None).cast("binary").alias("_spans"), F.lit(None).cast("array<string>").alias("_items"))
    rest = blocks(benchmark, item, phrase)
    block = next(rest, None)
    while (following := next(rest, None)) is not None:
        out = stage(out.mapInArrow(_search(block, text), out.schema), "decontaminate-pass")
        block = following
    return out.mapInArrow(_search(block, text, finish), schema)


def contamination(documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", phrase: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document.

    Words are runs of digits, letters A-Z in either case and characters beyond ASCII. A slice of a task's
    texts is a shard: its words get an FM-index, in which all windows of the test set are searched. The test
    set goes to the tasks in blocks of bounded size, one pass for each, without a shuffle. Null and empty
    texts have no words and no hits; null item ids hit words but name no item; repeated rows and items
    change nothing for others; an empty test set hits nothing.
    """

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        merged = [_merged(raw) for raw in batch.column("_spans").to_pylist()]
        hits = np.array([int((m[:, 1] - m[:, 0]).sum()) for m in merged], dtype=np.int64)
        named = [sorted(set(i or [])) for i in batch.column("_items").to_pylist()]
        digests = [sha256(",".join(i).encode()).hexdigest() for i in named]
        columns = [batch.column("doc_id"), batch.column("_words"), pa.array(hits), pa.array([len(i) for i in named], type=pa.int64()), pa.array(digests, type=pa.string()), pa.array(hits > 0)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    return _searched(documents.select("doc_id", text), benchmark, text, item, phrase, finish, schema)


def remove_hits(documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", phrase: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The documents with every merged span of hit words cut out of the text, from the first byte of its first
    word to the last byte of its last. Texts without hits stay as they are; ``length`` names a column of
    lengths in characters to correct. Columns stay, whatever their names."""
    names = documents.columns
    renamed = documents.toDF(*[f"c{i}" for i in range(len(names))])
    at, length = names.index(text), names.index(length) if length in names else None
    held, kept = f"c{at}", renamed.columns

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, spans = batch.column(at).to_pylist(), batch.column("_spans").to_pylist()
        sizes = batch.column(length).to_pylist() if length is not None else None
        for i, raw in enumerate(spans):
            if raw:
                whole, out, done = texts[i].encode(), [], 0
                for _, _, x, y in _merged(raw).tolist():
                    out.append(whole[done:x])
                    done = y
                texts[i] = (b"".join(out) + whole[done:]).decode()
                if sizes is not None:
                    sizes[i] = len(texts[i])
        columns = {held: pa.array(texts, type=pa.string())} | ({f"c{length}": pa.array(sizes)} if sizes is not None else {})
        return replaced(batch.select(kept), **columns)

    return _searched(renamed, benchmark, held, item, phrase, finish, renamed.schema).toDF(*names)
