"""Suffix-array dedup: passages of a fixed length that start more than once anywhere are cut out.

Sorting every suffix of a corpus would move each byte many times. Two suffixes with equal first ``LENGTH`` bytes
have the same least 64-byte gram in these, at the same distance (the anchor, which follows from the bytes alone).
So suffixes are put into buckets by anchor, buckets with one anchor position are dropped, and what is left is sorted
bucket by bucket with a difference cover, on the bytes themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import covered, mix, runs, slices, span_hashes, sum_hashes, utf8, window_hashes
from millrace.session import stage

LENGTH = 200
GRAM = 64
PERIOD = 32  # of the difference cover
BLOCK = 1 << 17  # suffixes sorted at a time
CHUNK_BYTES = 1 << 21
HOT = 256  # different surroundings of an anchor above which its bucket is split by longer prefixes
WIDTHS = (None, 8, 1)  # starts that share a bucket: all of an anchor, eight neighbours, single ones
PIECE = "core long, slice long, p int, s int, e int"


@cache
def cover(period: int) -> tuple[np.ndarray, np.ndarray]:
    """A difference cover: residues such that any two residues reach one of them by a common step below ``period``,
    and that step for each pair. Residues are added as long as a difference is missing, the most useful first."""
    held, missing = [0], set(range(1, period))
    while missing:
        gain = lambda r: len(missing & {(r - h) % period for h in held} | missing & {(h - r) % period for h in held})
        best = max(range(period), key=gain)
        missing -= {(best - h) % period for h in held} | {(h - best) % period for h in held}
        held.append(best)
    inside = np.zeros(period, dtype=bool)
    inside[held] = True
    steps = np.array([[next(d for d in range(period) if inside[(i + d) % period] and inside[(j + d) % period]) for j in range(period)] for i in range(period)])
    return inside, steps


def _leading(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as a number that sorts like them."""
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)[at]).view(">u8").ravel().astype(np.uint64)


class CoverRanks:
    """Ranks of the suffixes that start at the cover's residues, by at least ``depth`` bytes.

    ``data`` must end with enough padding. The samples of one residue are a period apart, so ranks of twice the
    length come from pairs of ranks.
    """

    def __init__(self, data: np.ndarray, size: int, depth: int):
        inside, self.steps = cover(PERIOD)
        self.per = int(inside.sum())
        self.nth = np.cumsum(inside) - inside
        at = np.flatnonzero(np.tile(inside, size // PERIOD + 2))
        at = at[at < len(data) - PERIOD - 8]
        keys = [_leading(data, at + o) for o in range(PERIOD - 8, -1, -8)]
        order = np.lexsort(keys)
        new = np.zeros(len(at), dtype=bool)
        for k in keys:
            new[1:] |= k[order][1:] != k[order][:-1]
        self.rank = np.empty(len(at), dtype=np.int64)
        self.rank[order] = np.cumsum(new) + 1
        known = PERIOD
        while known < depth:
            ahead = self.per * (known // PERIOD)
            pair = self.rank * (len(at) + 2) + np.concatenate([self.rank[ahead:], np.zeros(min(ahead, len(at)), dtype=np.int64)])
            order = np.argsort(pair, kind="stable")
            ranked = np.concatenate([[0], np.cumsum(pair[order][1:] != pair[order][:-1])]) + 1
            self.rank[order] = ranked
            known *= 2

    def of(self, at: np.ndarray) -> np.ndarray:
        return self.rank[at // PERIOD * self.per + self.nth[at % PERIOD]]


def _untie(suffixes: np.ndarray, group: np.ndarray, ranks: CoverRanks) -> np.ndarray:
    """Sorts suffixes that are equal in their first period. All groups are split at once around one member each:
    two suffixes compare like the ranks of the samples they reach by the step that the cover has for the two."""
    suffixes, group = suffixes.copy(), group.copy()
    active = np.arange(len(suffixes))
    while len(active):
        own, g = suffixes[active], group[active]
        heads = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        sizes = np.diff(np.append(heads, len(g)))
        pivot = np.repeat(own[heads + sizes // 2], sizes)
        step = ranks.steps[own % PERIOD, pivot % PERIOD]
        side = np.sign(ranks.of(own + step) - ranks.of(pivot + step))
        order = np.lexsort((side, g))
        own, side, g = own[order], side[order], g[order]
        suffixes[active] = own
        part = np.concatenate([[True], (g[1:] != g[:-1]) | (side[1:] != side[:-1])])
        first = np.flatnonzero(part)
        group[active] = active[np.repeat(first, np.diff(np.append(first, len(g))))]
        many = np.repeat(np.diff(np.append(first, len(g))) > 1, np.diff(np.append(first, len(g))))
        active = active[many & (side != 0)]
    return suffixes


def sorted_blocks(data: np.ndarray, suffixes: np.ndarray, size: int, depth: int) -> Iterator[np.ndarray]:
    """The suffixes in order, one block at a time: blocks take the suffixes between two leading values, are sorted
    by their first period and, where that ties, by the ranks of cover samples computed before."""
    ranks = CoverRanks(data, size, depth)
    leading = _leading(data, suffixes)
    drawn = np.sort(leading)[BLOCK // 2 :: BLOCK // 2]
    bucket = np.searchsorted(np.unique(drawn), leading, side="right")
    by = np.argsort(bucket, kind="stable")
    for part in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1):
        own = suffixes[part]
        keys = [*(_leading(data, own + o) for o in range(PERIOD - 8, 0, -8)), leading[part]]
        order = np.lexsort(keys)
        own = own[order]
        new = np.zeros(len(own), dtype=bool)
        new[:1] = True
        for k in keys:
            new[1:] |= k[order][1:] != k[order][:-1]
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(own)))
        tied = np.repeat(sizes > 1, sizes)
        own[tied] = _untie(own[tied], np.repeat(first, sizes)[tied], ranks)
        yield own


def repeated(data: np.ndarray, suffixes: np.ndarray, size: int, depth: int = LENGTH) -> np.ndarray:
    """For each suffix (by position in ``data``) whether another one of them has the same first ``depth`` bytes:
    neighbours in order are compared byte for byte."""
    marked = np.zeros(size, dtype=bool)
    for own in sorted_blocks(data, suffixes, size, depth):
        same = np.arange(len(own) - 1)
        for o in [*range(0, depth - 7, 8), depth - 8]:
            same = same[_leading(data, own[same] + o) == _leading(data, own[same + 1] + o)]
        marked[own[same]] = True
        marked[own[same + 1]] = True
    return marked[suffixes]


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of starts with one anchor: first start, last start, anchor, the anchor's hash, row.

    A start's anchor is the position of the least gram hash inside its ``length`` bytes, the leftmost if some are equal.
    """
    reach, step = length - gram + 1, 1 << 18
    firsts, lasts, places, values = [], [], [], []
    total = len(data) - length + 1
    last_start = np.maximum(offsets[1:] - length, offsets[:-1] - 1)
    for a in range(0, max(total, 0), step):
        count = min(step, total - a)
        grams = window_hashes(data[a : a + count + length - 1], gram)
        key = grams >> np.uint64(20) << np.uint64(20) | np.arange(len(grams), dtype=np.uint64)
        width = -len(key) % reach
        table = np.concatenate([key, np.full(width, np.iinfo(np.uint64).max)]).reshape(-1, reach)
        before = np.minimum.accumulate(table, axis=1).ravel()
        after = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
        place = (np.minimum(after[:count], before[reach - 1 : reach - 1 + count]) & np.uint64((1 << 20) - 1)).astype(np.int64)
        row = np.searchsorted(offsets, np.arange(a, a + count), side="right") - 1 if len(offsets) > 2 else np.zeros(count, dtype=np.int64)
        valid = np.arange(a, a + count) <= last_start[row]
        turn = np.concatenate([[True], (place[1:] != place[:-1]) | (row[1:] != row[:-1]) | (valid[1:] != valid[:-1])])
        first = np.flatnonzero(turn)
        last = np.append(first[1:], count) - 1
        good = valid[first]
        first, last = first[good], last[good]
        firsts.append(first + a)
        lasts.append(last + a)
        places.append(place[first] + a)
        values.append(grams[place[first]])
    if not firsts:
        none = np.empty(0, dtype=np.int64)
        return none, none, none, none.astype(np.uint64), none
    s, e, p, h = (np.concatenate(x) for x in (firsts, lasts, places, values))
    # a stretch that goes on over the edge of a part is one
    row = np.searchsorted(offsets, s, side="right") - 1
    joined = np.concatenate([[False], (p[1:] == p[:-1]) & (row[1:] == row[:-1]) & (s[1:] == e[:-1] + 1)])
    head = np.flatnonzero(~joined)
    return s[head], e[np.append(head[1:], len(s)) - 1], p[head], h[head], row[head]


def _pieces(data: np.ndarray, s: np.ndarray, e: np.ndarray, p: np.ndarray, width: int | None, length: int) -> tuple[np.ndarray, ...]:
    """Splits stretches of starts into pieces of ``width`` distances to the anchor. Each has the hash of the bytes
    common to all starts that can be in such a piece (the core) and that of all its bytes (the slice)."""
    if width is None:
        core = sum_hashes(data, p, p + GRAM, seed=3)
        first, last, at = s, e, p
    else:
        low, high = (p - e) // width, (p - s) // width
        count = high - low + 1
        block = np.repeat(high, count) - (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
        at, s, e = (np.repeat(x, count) for x in (p, s, e))
        first, last = np.maximum(s, at - block * width - width + 1), np.minimum(e, at - block * width)
        inner = at - block * width
        order = np.argsort(inner, kind="stable")  # a stretch may end behind the first core of the next one
        core = np.empty(len(at), dtype=np.uint64)
        core[order] = sum_hashes(data, inner[order], inner[order] + length + 1 - width, seed=3)
        core = mix(core + block.astype(np.uint64))
    slice_hashes = span_hashes if width is None else sum_hashes  # whole stretches have any length
    part = mix(slice_hashes(data, first, last + length, seed=4) + (at - first).astype(np.uint64))
    return core.view(np.int64), part.view(np.int64), at, first, last


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's anchor hashes, once each, and whether the text has one at two positions."""
    for batch in slices(batches, "text"):
        data, offsets = utf8(batch.column("text"))
        _, _, p, h, row = anchors(data, offsets)
        new = np.concatenate([[True], (p[1:] != p[:-1]) | (row[1:] != row[:-1])]) if len(p) else np.empty(0, bool)
        h, row = h[new], row[new]
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        head = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])) if len(h) else np.empty(0, np.int64)
        twice = np.diff(np.append(head, len(h))) > 1
        digest = batch.column("hash").to_numpy(zero_copy_only=False)[row[head]]
        yield pa.RecordBatch.from_arrays([pa.array(h[head].view(np.int64)), pa.array(digest), pa.array(twice)], names=["anchor", "hash", "twice"])


PIECES = pa.list_(pa.struct([("core", pa.int64()), ("slice", pa.int64()), ("p", pa.int32()), ("s", pa.int32()), ("e", pa.int32())]))


def _lists(row: np.ndarray, n: int, columns: tuple[np.ndarray, ...], first: np.ndarray) -> pa.Array:
    """Pieces as one list per row, positions counted from the row's start."""
    core, part, p, s, e = columns
    shift = first[row]
    flat = pa.StructArray.from_arrays([pa.array(core), pa.array(part), *(pa.array((x - shift).astype(np.int32)) for x in (p, s, e))], fields=list(PIECES.value_type))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), flat)


def _first_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the pieces around those anchors of a text that stand in its list."""
    for batch in slices(batches, "text"):
        data, offsets = utf8(batch.column("text"))
        s, e, p, h, row = anchors(data, offsets)
        known = batch.column("anchors")
        flat = known.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        owner = np.repeat(np.arange(batch.num_rows), np.diff(known.offsets.to_numpy()))
        seed = np.uint64(0xA24BAED4963EE407)
        wanted = np.isin(mix(h + row.astype(np.uint64) * seed), mix(flat + owner.astype(np.uint64) * seed))
        columns = _pieces(data, s[wanted], e[wanted], p[wanted], None, LENGTH)
        names = [c for c in batch.schema.names if c not in ("anchors", "hash")]
        yield pa.RecordBatch.from_arrays([*batch.select(names).columns, _lists(row[wanted], batch.num_rows, columns, offsets[:-1])], names=[*names, "pieces"])


def _stretches(batch: pa.RecordBatch, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The stretches asked for in column ``wanted`` in order, with their rows; positions in the slice's bytes."""
    lists = batch.column("wanted")
    row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
    flat = lists.flatten()
    p, s, e = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) + offsets[row] for c in ("p", "s", "e"))
    order = np.argsort(s, kind="stable")
    return p[order], s[order], e[order], row[order]


def _split_pieces(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = utf8(batch.column("text"))
            p, s, e, row = _stretches(batch, offsets)
            core, part, at, first, last = _pieces(data, s, e, p, width, LENGTH)
            owner = np.searchsorted(offsets, first, side="right") - 1
            shift = offsets[owner]
            yield pa.RecordBatch.from_arrays([batch.column("digest").take(pa.array(owner)), pa.array(core), pa.array(part), *(pa.array((x - shift).astype(np.int32)) for x in (at, first, last))], names=["digest", "core", "slice", "p", "s", "e"])

    return run


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes around the stretches asked for."""
    for batch in slices(batches, "text"):
        data, offsets = utf8(batch.column("text"))
        raw = data.tobytes()
        lists = batch.column("wanted")
        row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        flat = lists.flatten()
        s, e = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("s", "e"))
        shift = offsets[row]
        bodies = pa.array([raw[a:b] for a, b in zip((s + shift).tolist(), (e + shift + LENGTH).tolist(), strict=True)], type=pa.binary())
        yield pa.RecordBatch.from_arrays([flat.field("core"), bodies, batch.column("digest").take(pa.array(row)), pa.array(s.astype(np.int32)), flat.field("open")], names=["core", "body", "digest", "s", "open"])


def _sort_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorts the suffixes of whole buckets, about ``CHUNK_BYTES`` of bytes at a time, and returns the repeated ones."""

    def solve(rows: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = utf8(rows.column("body"))
        padded = np.concatenate([data, np.zeros(2 * LENGTH + 2 * PERIOD, dtype=np.uint8)])
        counts = np.diff(offsets) - LENGTH + 1
        owner = np.repeat(np.arange(rows.num_rows), counts)
        suffixes = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts - offsets[:-1], counts)
        hit = repeated(padded, suffixes, len(data)) & rows.column("open").to_numpy(zero_copy_only=False)[owner]
        edge = np.flatnonzero(np.diff(owner)) + 1
        start, stop = runs(hit)
        inner = edge[hit[edge] & hit[edge - 1]]
        start, stop = np.union1d(start, inner).astype(np.int64), np.union1d(stop, inner).astype(np.int64)
        of = owner[start]
        first = suffixes[start] - offsets[of] + rows.column("s").to_numpy()[of]
        return pa.RecordBatch.from_arrays([rows.column("digest").take(pa.array(of)), pa.array(first.astype(np.int32)), pa.array((first + stop - start - 1).astype(np.int32))], names=["digest", "s", "e"])

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in slices(batches, "body", CHUNK_BYTES // 2):
        held.append(batch)
        size += batch.column("body").nbytes
        if size < CHUNK_BYTES:
            continue
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        core = whole.column("core").to_numpy()
        cut = int(np.searchsorted(core, core[-1]))  # rows come in order of the bucket; the last may go on
        if cut:
            yield solve(whole.slice(0, cut))
        held = [whole.slice(cut)]
        size = held[0].column("body").nbytes
    if held:
        yield solve(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def _digest(text: str = "text") -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _ask(texts: DataFrame, wanted: DataFrame, columns: list[str]) -> DataFrame:
    """Texts with a list of the stretches wanted of them."""
    return texts.select("digest", "text").join(wanted.groupBy("digest").agg(F.collect_list(F.struct(*columns)).alias("wanted")), "digest")


def repeats(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored (digest, text, copies) of texts with copies or an anchor found twice, and (digest, s, e): stretches of starts of
    passages that occur elsewhere. Copies of a text count as one there; ``copies`` tells how many there are."""
    texts = documents.select(F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") >= LENGTH).select("text", F.xxhash64("text").alias("hash"))
    rows = texts.mapInArrow(_anchor_rows, "anchor long, hash long, twice boolean")
    spread = rows.groupBy("anchor").agg(F.min("hash").alias("a"), F.max("hash").alias("b"), F.max("twice").alias("t"))
    shared = stage(spread.where("a != b or t").select("anchor"), "suffix-anchors")
    copies = texts.select(F.unhex(F.md5("text")).alias("digest"), "text", "hash").groupBy("digest").agg(F.first("text").alias("text"), F.first("hash").alias("hash"), F.count(F.lit(1)).alias("copies"))
    lists = rows.select("anchor", "hash").join(shared, "anchor").groupBy("hash").agg(F.collect_set("anchor").alias("anchors"))
    lists = stage(lists, "suffix-lists")
    held = copies.join(lists, "hash", "left").where("copies > 1 or anchors is not null").select("digest", "text", "copies", "hash", "anchors").mapInArrow(_first_pieces, f"digest binary, text string, copies long, pieces array<struct<{PIECE.replace(' ', ':')}>>".replace(",:", ","))
    held = stage(held, "suffix-texts")
    found, pieces = [], held.select("digest", F.inline("pieces"))
    for n, width in enumerate(WIDTHS):
        if n:
            pieces = stage(pieces, "suffix-pieces")
        kinds = pieces.groupBy("core", "slice").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("digest", "p", "s", "e")).alias("one"))
        kinds = stage(kinds, "suffix-kinds")
        again = kinds.where("n > 1").select("core", "slice")
        found.append(pieces.join(again, ["core", "slice"]).select("digest", "s", "e"))
        if width == 1:
            break
        buckets = stage(kinds.groupBy("core").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "suffix-buckets")
        chosen = kinds.join(buckets, "core").select("core", "kinds", "one.*", (F.col("n") == 1).alias("open"))
        chosen = stage(chosen, "suffix-chosen")
        few = _ask(held, chosen.where(F.col("kinds") <= HOT), ["core", "s", "e", "open"])
        bodies = few.mapInArrow(_contexts, "core long, body binary, digest binary, s int, open boolean")
        found.append(bodies.repartition("core").sortWithinPartitions("core").mapInArrow(_sort_buckets, "digest binary, s int, e int"))
        many = _ask(held, chosen.where(F.col("kinds") > HOT), ["p", "s", "e"])
        pieces = many.mapInArrow(_split_pieces(WIDTHS[n + 1]), f"digest binary, {PIECE}")
    stretches = found[0]
    for more in found[1:]:
        stretches = stretches.unionByName(more)
    return held.select("digest", "text", "copies"), stage(stretches, "suffix-starts")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text the bytes covered by a repeated passage, counted and cut out; of copies all."""
    for batch in slices(batches, "text"):
        n = batch.num_rows
        removed, spans, digests, kept = np.zeros(n, np.int64), np.zeros(n, np.int64), [], []
        copies = batch.column("copies").to_numpy()
        lists = batch.column("starts").to_pylist()
        data, offsets = utf8(batch.column("text"))
        for i in range(n):
            own = data[offsets[i] : offsets[i + 1]]
            if copies[i] > 1:
                hit = np.ones(len(own), dtype=bool)
            else:
                found = lists[i] or []
                hit = covered(np.array([x["s"] for x in found], dtype=np.int64), np.array([x["e"] + LENGTH for x in found], dtype=np.int64), len(own))
            rest = own[~hit].tobytes()
            removed[i], spans[i] = hit.sum(), len(runs(hit)[0])
            digests.append(sha256(rest).hexdigest())
            kept.append(rest.decode(errors="ignore"))
        yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(removed), pa.array(spans), pa.array(digests), pa.array(kept, type=pa.string())], names=["digest", "n_removed", "n_spans", "kept_sha256", "kept"])


def cut_texts(documents: DataFrame) -> DataFrame:
    """(digest, n_removed, n_spans, kept_sha256 of the bytes left, whole characters left) of texts that share passages of 200 bytes or more."""
    held, stretches = repeats(documents)
    lists = stretches.groupBy("digest").agg(F.collect_list(F.struct("s", "e")).alias("starts"))
    asked = held.join(lists, "digest", "left").where("copies > 1 or starts is not null")
    return asked.mapInArrow(_cut, "digest binary, n_removed long, n_spans long, kept_sha256 string, kept string")


def dedup(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document.

    A byte is removed if a 200-byte string that covers it also starts anywhere else in the corpus, in the same
    document or another. Strings are judged on the input; matches never go over the end of a document. Null
    texts count as empty; texts of fewer than 200 bytes lose nothing; of equal longer texts nothing is left.
    Repeated rows are documents of their own.
    """
    cut = stage(cut_texts(documents).drop("kept"), "suffix-results")
    held = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", _digest().alias("digest"), F.octet_length(held).cast("long").alias("n_bytes"), F.sha2(held.cast("binary"), 256).alias("whole"))
    none = F.lit(0).cast("long")
    return rows.join(cut, "digest", "left").select("doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"))


def without_repeats(documents: DataFrame, length: str | None = "n_chars") -> DataFrame:
    """The documents without bytes covered by repeated passages; characters of which bytes are left over at an edge
    go, too. ``length`` names a column of lengths in characters to correct. Other columns stay, whatever their names."""
    names = documents.columns
    at = {c: f"c{i}" for i, c in enumerate(names)}
    cut = stage(cut_texts(documents).select(F.col("digest").alias("_digest"), F.col("kept").alias("_kept")), "suffix-results")
    rows = documents.toDF(*at.values()).withColumn("_key", _digest(at["text"]))
    joined = rows.join(cut, F.col("_key") == F.col("_digest"), "left")
    text = F.coalesce("_kept", at["text"])
    out = joined.withColumn("_text", text)
    chosen = [F.col("_text") if c == "text" else F.when(F.col("_kept").isNotNull(), F.length("_text")).otherwise(F.col(a)).cast(documents.schema[c].dataType) if c == length else F.col(a) for c, a in at.items()]
    return out.select(*[x.alias(c) for x, c in zip(chosen, names, strict=True)])
