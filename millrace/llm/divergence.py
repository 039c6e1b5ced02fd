"""How far the sources of a language differ in their words, on run-length encoded count columns.

Each source of a language is a column of counts over the language's vocabulary. The vocabulary is put into an order in
which equal counts stand together, columns are run-length encoded block by block, and two columns are compared run by
run: their boundaries are merged, and the difference of a run counts as often as the run is long.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.batches import LOWER, slices, utf8, words
from millrace.session import stage

# letters and everything beyond ASCII, after lower-casing: [^\x00-\x40\x5B-\x60\x7B-\x7F]
LETTERS = np.zeros(256, dtype=bool)
LETTERS[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LEAST_DOCUMENTS = 30
TOP_TERMS = 50
SMOOTHING = 5
UNIT = 1_000_000_000
BLOCK = 4_096  # words of the vocabulary
LEADING = 64  # columns that decide the order of the vocabulary
TILE = 64  # columns of a language compared in one task
SLICE = 8 << 20
HELD, HELD_BYTES = 1_000_000, 64 << 20


class _Held:
    """Counts of a task: groups and terms are numbered, and a count belongs to (group, term)."""

    def __init__(self):
        self.groups: dict[tuple, int] = {}
        self.terms = pa.array([], pa.large_binary())
        self.at, self.n, self.docs = (np.empty(0, dtype=np.int64) for _ in range(3))

    def add(self, batch: pa.RecordBatch) -> None:
        """Count the terms of a slice: first those of each text, then of each group."""
        data, offsets = utf8(batch.column("text"))
        data = LOWER[data]
        starts, ends, rows = words(data, offsets, LETTERS)
        places = np.zeros(len(starts) + 1, dtype=np.int64)
        np.cumsum(ends - starts, out=places[1:])
        coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(data[LETTERS[data]])]).dictionary_encode()
        own, times = np.unique(rows * len(coded.dictionary) + coded.indices.to_numpy(), return_counts=True)
        row, code = np.divmod(own, max(len(coded.dictionary), 1))
        known = len(self.terms)
        both = pa.concat_arrays([self.terms, coded.dictionary]).dictionary_encode()
        self.terms = both.dictionary  # earlier terms keep their numbers
        code = both.indices.to_numpy()[known:][code]
        group = np.array([self.groups.setdefault(g, len(self.groups)) for g in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)])
        at, place = np.unique(np.concatenate([self.at, group[row] << 32 | code]), return_inverse=True)
        self.n = np.bincount(place, np.concatenate([self.n, times]), len(at)).astype(np.int64)
        self.docs = np.bincount(place, np.concatenate([self.docs, np.ones(len(row), np.int64)]), len(at)).astype(np.int64)
        self.at = at

    def full(self) -> bool:
        return len(self.at) > HELD or self.terms.nbytes > HELD_BYTES

    def shown(self) -> Iterator[pa.RecordBatch]:
        """In batches of a bounded size."""
        langs, sources = (pa.array([g[i] for g in self.groups], pa.string()) for i in range(2))
        names = ["lang", "source", "term", "n", "docs"]
        for first in range(0, len(self.at), 50_000):
            part = slice(first, first + 50_000)
            group, code = self.at[part] >> 32, self.at[part] & 0xFFFFFFFF
            terms = self.terms.take(pa.array(code)).cast(pa.large_string()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(group)), sources.take(pa.array(group)), terms, pa.array(self.n[part]), pa.array(self.docs[part])], names=names)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of slices, added up as far as a task's memory allows."""
    held = _Held()
    for batch in slices(batches, "text", SLICE):
        held.add(batch)
        if held.full():
            yield from held.shown()
            held = _Held()
    yield from held.shown()


def kept_cells(rows: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, source, term, n, total), stored, of the terms that at least so many documents of their language hold: the
    occurrences in the source's texts and in all of the language.

    Tasks add up what they read. What they send is dealt by language and term, so that one shuffle serves for the
    counts of the sources and those of the language, and rare terms are gone before anything is stored.
    """
    parts = rows.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    everywhere = Window.partitionBy("term", "lang")
    counted = parts.repartition("term", "lang").withColumn("all_docs", F.sum("docs").over(everywhere)).where(F.col("all_docs") >= least)
    counted = counted.groupBy("term", "lang", "source").agg(F.sum("n").alias("n")).withColumn("total", F.sum("n").over(everywhere))
    return stage(counted.select("lang", "source", "term", "n", "total"), "audit-cells")


def _share(count: Column, total: Column, words: Column) -> Column:
    """1 + floor(UNIT * (count + 5) / (total + 5 * words)); in decimals where UNIT times the count leaves a long."""
    below = total + words * SMOOTHING
    small = F.call_function("div", (count + SMOOTHING) * F.lit(UNIT).cast("long"), below)
    large = F.call_function("div", (count.cast("decimal(20,0)") + SMOOTHING) * F.lit(UNIT).cast("decimal(10,0)"), below.cast("decimal(20,0)"))
    return F.lit(1) + F.when(count < 1 << 33, small).otherwise(large)


def vocabulary(cells: DataFrame, block: int = BLOCK) -> DataFrame:
    """(lang, term, total, block, place) of the kept terms, stored; a block belongs to a range of the order, and places
    run from 0 in each language of a block.

    The order is that of the terms' counts in up to LEADING columns, those with the most terms, of these the one with
    the fewest different counts first, as runs stay longest if columns of few values lead. It decides how long runs
    are, never a result.
    """
    columns = cells.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("terms"), F.approx_count_distinct("n").alias("kinds"))
    by_size = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("terms"), "source"))
    lead = columns.withColumn("at", by_size).where(F.col("at") <= LEADING)
    lead = lead.withColumn("column", F.row_number().over(Window.partitionBy("lang").orderBy("kinds", "source"))).select("lang", "source", "column")
    entry = F.when(F.col("column").isNotNull(), F.struct("column", "n"))
    keys = cells.join(lead, ["lang", "source"], "left").groupBy("lang", "term", "total").agg(F.sort_array(F.collect_list(entry)).alias("key"))
    keys = stage(keys, "audit-keys")
    parts = max(1, math.ceil(keys.count() / block))
    ranged = stage(keys.repartitionByRange(parts, "lang", "key", "term").withColumn("block", F.spark_partition_id()), "audit-ranges")
    place = F.row_number().over(Window.partitionBy("block", "lang").orderBy("key", "term")) - 1
    return stage(ranged.select("lang", "term", "total", "block", place.alias("place")), "audit-vocabulary")


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns of a block, (place, p) where the count is not 0, as runs over all places: where each begins, and its p."""
    for batch in batches:
        starts, values = [], []
        places, shares = batch.column("places"), batch.column("shares")
        for i, (size, zero) in enumerate(zip(batch.column("size").to_pylist(), batch.column("zero").to_pylist(), strict=True)):
            column = np.full(size, zero, dtype=np.int64)
            if places[i].is_valid:
                column[places[i].values.to_numpy()] = shares[i].values.to_numpy()
            begins = np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]])) if size else np.empty(0, dtype=np.int64)
            starts.append(begins.astype(np.int32))
            values.append(column[begins])
        kept = [batch.column(c) for c in ("lang", "source", "block", "size")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(starts, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.int64()))], names=["lang", "source", "block", "size", "starts", "ps"])


def difference(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], size: int) -> int:
    """Sum of |p - q| over all places of two columns in runs: boundaries are merged, f is multiplied by the length."""
    at = np.union1d(a[0], b[0])
    lengths = np.diff(np.append(at, size))
    p = a[1][np.searchsorted(a[0], at, side="right") - 1]
    q = b[1][np.searchsorted(b[0], at, side="right") - 1]
    return int((np.abs(p - q) * lengths).sum())


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a block for each pair of columns, one of the tile ``low`` and one of ``high``; low columns come first."""
    names = ["lang", "block", "low", "high"]
    at, held = None, []
    for batch in batches:
        out = []
        keys = list(zip(*(batch.column(c).to_pylist() for c in names), strict=True))
        cells = zip(batch.column("source").to_pylist(), batch.column("tile").to_pylist(), batch.column("size").to_pylist(), batch.column("starts"), batch.column("ps"), strict=True)
        for key, (source, tile, size, starts, ps) in zip(keys, cells, strict=True):
            if key != at:
                at, held = key, []
            own = starts.values.to_numpy(), ps.values.to_numpy()
            low, high = key[2:]
            if low == high or tile != low:
                out += [(key[0], other, source, difference(runs, own, size) if size else 0) for other, runs in held]
            if tile == low:
                held.append((source, own))
        columns = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "a", "b", "value"])


def _pairs(groups: DataFrame, cells: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, source, item, value) for all ordered pairs of sources of a language."""
    sizes = terms.groupBy("lang", "block").agg(F.count(F.lit(1)).cast("int").alias("size"))
    blocks = groups.select("lang").distinct().join(sizes, "lang", "left").select("lang", F.coalesce("block", F.lit(-1)).alias("block"), F.coalesce("size", F.lit(0)).alias("size"))
    filled = cells.groupBy("lang", "source", "block").agg(F.collect_list(F.struct("place", "p")).alias("cells"))
    filled = filled.select("lang", "source", "block", F.col("cells.place").alias("places"), F.col("cells.p").alias("shares"))
    whole = groups.select("lang", "source", "zero").join(blocks, "lang").join(filled, ["lang", "source", "block"], "left")
    parts = max(int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(terms.count() / BLOCK))
    whole = whole.repartition(parts, "lang", "source", "block")
    runs = stage(whole.mapInArrow(_encode, "lang string, source string, block int, size int, starts array<int>, ps array<long>"), "audit-runs")
    tiles = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    placed = runs.join(tiles, "lang").withColumn("tile", F.pmod(F.xxhash64("source"), "tiles").cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda i: F.struct(F.least("tile", i).alias("low"), F.greatest("tile", i).alias("high")))
    sent = placed.select("lang", "block", "source", "tile", "size", "starts", "ps", F.explode(meets).alias("m")).select("*", "m.low", "m.high").drop("m")
    both = sent.repartition(parts, "lang", "block", "low", "high").sortWithinPartitions("lang", "block", "low", "high", "tile", "source")
    sums = both.mapInArrow(_compare, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return sums.select("lang", "value", ways.alias("w")).select("lang", "w.source", "w.item", "value")


def audit(documents: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from every other one (part
    ``pair``, all of them), and the ``top`` terms it uses more than its language does (part ``term``).

    A language keeps the terms of at least ``least`` of its documents. Shares are whole numbers of a smoothed count,
    p = 1 + floor(1e9 * (count + 5) / (N + 5 V)), and all sums are exact. Null lang, source and text count as empty,
    a group without terms takes part with counts of 0, and without kept terms all pairs have the value 0. Repeated
    documents count as often as they are there. An empty table gives an empty result. No other column is read.
    """
    rows = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    held = kept_cells(rows, least)
    terms = vocabulary(held, block)
    langs = terms.groupBy("lang").agg(F.sum("total").alias("all_n"), F.count(F.lit(1)).alias("words"))
    sums = held.groupBy("lang", "source").agg(F.sum("n").alias("own_n"))
    groups = rows.select("lang", "source").distinct().join(langs, "lang", "left").join(sums, ["lang", "source"], "left").na.fill(0, ["all_n", "words", "own_n"])
    zero = F.when(F.col("words") > 0, _share(F.lit(0), F.col("own_n"), F.col("words"))).otherwise(0)
    groups = stage(groups.withColumn("zero", zero), "audit-groups")
    cells = held.drop("total").join(terms, ["lang", "term"]).join(groups, ["lang", "source"])
    shares = stage(cells.select("lang", "source", "term", "block", "place", _share(F.col("n"), F.col("own_n"), F.col("words")).alias("p"), _share(F.col("total"), F.col("all_n"), F.col("words")).alias("q")), "audit-shares")
    pairs = _pairs(groups, shares, terms).withColumn("part", F.lit("pair"))
    above = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"), F.lit("term").alias("part"))
    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    first = above.withColumn("rank", place).where(F.col("rank") <= top)
    return pairs.withColumn("rank", place).unionByName(first).select("lang", "source", "part", "item", "value", "rank")
