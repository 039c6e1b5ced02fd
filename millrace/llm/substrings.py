"""Substring dedup: content-defined chunks, deduplicated by digest."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import covered, runs, slices, span_hashes, utf8
from millrace.llm.chunks import cuts
from millrace.session import stage

BITS = 5
LEAST = 48


def bounds(data: np.ndarray, offsets: np.ndarray, bits: int = BITS, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the chunks: cuts of the rolling hash, but none within ``least`` bytes of the one before in
    the same row, nor of the row's end. Chunks average ``least + 2**bits`` bytes; after a change the cuts are the
    old ones again as soon as one of them is free in both versions."""
    marked = cuts(data, offsets, bits)
    row = np.searchsorted(offsets, marked, side="right") - 1
    kept, last, now, limit = [], 0, -1, 0
    stops = offsets[1:].tolist()
    for at, r in zip(marked.tolist(), row.tolist(), strict=True):
        if r != now:
            kept.append(at)
            now, last, limit = r, at, stops[r] - least
        elif at - last >= least and at <= limit:
            kept.append(at)
            last = at
    starts = np.array(kept, dtype=np.int64)
    return starts, np.append(starts[1:], len(data)).astype(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        data, offsets = utf8(batch.column("text"))
        s, e = bounds(data, offsets)
        long = e - s >= LEAST
        s, e = s[long], e[long]
        row = np.searchsorted(offsets, s, side="right") - 1
        first, second = span_hashes(data, s, e, seed=21).view(np.int64), span_hashes(data, s, e, seed=22).view(np.int64)
        shift = offsets[row]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), batch.column("hash").take(pa.array(row)), pa.array(first), pa.array(second), pa.array((s - shift).astype(np.int32)), pa.array((e - shift).astype(np.int32))], names=["doc_id", "hash", "d1", "d2", "s", "e"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        data, offsets = utf8(batch.column("text"))
        lists = batch.column("spans").to_pylist()
        removed, spans, digests, kept = [], [], [], []
        for i, found in enumerate(lists):
            own = data[offsets[i] : offsets[i + 1]]
            hit = covered(np.array([x["s"] for x in found or []], dtype=np.int64), np.array([x["e"] for x in found or []], dtype=np.int64), len(own))
            rest = own[~hit].tobytes()
            removed.append(int(hit.sum()))
            spans.append(len(runs(hit)[0]))
            digests.append(sha256(rest).hexdigest())
            kept.append(rest.decode(errors="ignore"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def dedup(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (text) of every document.

    A chunk stays where it occurs first, by doc_id (null last) and position; every later copy is cut out. Only
    chunks of 48 bytes or more are compared, by a 128-bit digest, so common words stay. Chunks of one occurrence
    are dropped by digest before the rest is joined; joins on a digest that many documents share are between
    stored tables and shuffled rows, which adaptive execution splits, and first places are minima combined before
    the shuffle. Null and empty texts lose nothing. Rows equal in id and text count as one document.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    texts = documents.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    rows = texts.mapInArrow(_chunks, f"doc_id {kind}, hash long, d1 long, d2 long, s int, e int")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "hash", "s")
    mark = F.xxhash64("doc_id", "hash", "s")
    shared = rows.groupBy("d1").agg(F.min(mark).alias("a"), F.max(mark).alias("b")).where("a != b").select("d1")
    again = stage(rows.join(stage(shared, "chunk-digests"), "d1"), "chunk-rows")
    first = stage(again.groupBy("d1", "d2").agg(F.min(place).alias("first")), "chunk-firsts")
    later = again.join(first, ["d1", "d2"]).where(place != F.col("first")).select("doc_id", "hash", "s", "e")
    lists = stage(later.groupBy("doc_id", "hash").agg(F.collect_set(F.struct("s", "e")).alias("spans")), "chunk-spans")
    lists = lists.select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"), "spans")
    asked = texts.join(lists, texts["doc_id"].eqNullSafe(lists["_id"]) & (texts["hash"] == lists["_hash"]), "left").select("doc_id", "text", "spans")
    return asked.mapInArrow(_cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string")
