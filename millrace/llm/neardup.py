"""Near duplicates: banded MinHash, odd sketches for candidates, links confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import LOWER, SPACED, mix, slices, span_hashes, utf8, words
from millrace.llm.components import components
from millrace.session import stage

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 24, 3  # two texts at the threshold share no band with a chance of 2e-6
ODD_BITS = 256
PARITY_BITS = 1024
LEAST_ESTIMATE = 0.4  # seven standard deviations of the estimate below the threshold
TILE, TILE_ITEMS = 512, 1 << 21
STEP = 128


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every row with their rows, in row order. A row of fewer than five words has one
    shingle, its whole sequence of words; a row without words has none."""
    data = LOWER[data]
    starts, ends, rows = words(data, offsets, SPACED)
    if not len(rows):
        return np.empty(0, dtype=np.uint64), rows
    hashes = span_hashes(data, starts, ends)
    counts = np.bincount(rows, minlength=len(offsets) - 1)
    width = np.minimum(counts, SHINGLE)[rows]
    last = np.cumsum(counts)[rows]
    at = np.arange(len(rows))
    at = at[at + width <= last]
    folded = np.zeros(len(at), dtype=np.uint64)
    for i in range(SHINGLE):
        more = width[at] > i
        folded = np.where(more, mix(folded) + hashes[np.minimum(at + i, len(hashes) - 1)] + np.uint64(1), folded)
    folded, owner = mix(folded), rows[at]
    keyed = mix(folded + owner.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    _, first = np.unique(keyed, return_index=True)
    first.sort()
    return folded[first], owner[first]


def _odds(count: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def _parity(rows: np.ndarray, values: np.ndarray, n: int, bits: int) -> np.ndarray:
    """One bitmap per row: each value flips the bit it hashes to."""
    cell = rows * bits + (values % np.uint64(bits)).astype(np.int64)
    flips = np.bincount(cell, minlength=n * bits).astype(np.uint8) & 1
    return np.packbits(flips.reshape(n, bits), axis=1)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    factors = _odds(BANDS * ROWS, 7)
    for batch in slices(batches, "text"):
        n = batch.num_rows
        found, rows = shingles(*utf8(batch.column("text")))
        sizes = np.bincount(rows, minlength=n)
        held = np.flatnonzero(sizes)
        heads = (np.cumsum(sizes) - sizes)[held]
        least = np.empty((len(held), BANDS * ROWS), dtype=np.uint64)
        for i, factor in enumerate(factors):
            least[:, i] = np.minimum.reduceat(found * factor, heads) if len(held) else 0
        bands = np.empty((len(held), BANDS), dtype=np.uint64)
        for b in range(BANDS):
            folded = np.full(len(held), b + 1, dtype=np.uint64)
            for i in range(ROWS):
                folded = mix(folded) + least[:, b * ROWS + i]
            bands[:, b] = mix(folded)
        place = np.arange(len(held))
        drawn = mix(least + _odds(BANDS * ROWS, 11))
        odd = _parity(np.repeat(place, BANDS * ROWS), drawn.reshape(-1), len(held), ODD_BITS)
        parity = _parity(np.repeat(place, sizes[held]), mix(found + np.uint64(5)), len(held), PARITY_BITS)
        key = np.stack([np.add.reduceat(mix(found + np.uint64(s)), heads) if len(held) else np.empty(0, np.uint64) for s in (17, 29)], axis=1)
        keys, odds, parities, lists = [None] * n, [None] * n, [None] * n, [None] * n
        for j, r in enumerate(held.tolist()):
            keys[r], odds[r], parities[r], lists[r] = key[j].tobytes(), odd[j].tobytes(), parity[j].tobytes(), bands[j].view(np.int64)
        columns = [pa.array(keys, pa.binary()), pa.array(sizes), pa.array(odds, pa.binary()), pa.array(parities, pa.binary()), pa.array(lists, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), *columns], names=["doc_id", "digest", "key", "n", "odd", "parity", "bands"])


def signatures(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, digest of its text, 128-bit key and size of its shingle set, odd sketch of its MinHash
    samples, parity bitmap of the set, and a hash per band. Equal sets have equal keys and all else."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("digest"), "text")
    return rows.mapInArrow(_signatures, f"doc_id {kind}, digest binary, key binary, n long, odd binary, parity binary, bands array<long>")


def _near(members: dict, a: slice, b: slice) -> tuple[np.ndarray, np.ndarray]:
    """Whether members of a group may be linked, and how far apart they look.

    The odd sketch estimates the similarity from the XOR of the folded samples. The XOR of two parity bitmaps has
    at most as many ones as the sets have elements not in common, so too many ones rule a link out for certain.
    """
    n, odd, parity = members["n"], members["odd"], members["parity"]
    ones = np.bitwise_count(odd[a, None, :] ^ odd[None, b, :]).sum(axis=2, dtype=np.int64)
    with np.errstate(divide="ignore"):
        estimate = 1 + ODD_BITS / (4 * BANDS * ROWS) * np.log(np.maximum(1 - 2 * ones / ODD_BITS, 0))
    apart = np.bitwise_count(parity[a, None, :] ^ parity[None, b, :]).sum(axis=2, dtype=np.int64)
    both = n[a, None] + n[None, b]
    possible = (estimate >= LEAST_ESTIMATE) & (apart * (100 + PERCENT) <= both * (100 - PERCENT)) & (members["label"][a, None] != members["label"][None, b])
    return possible, apart / np.maximum(both, 1)


def _members(part: pa.RecordBatch) -> dict:
    """The columns of a group as arrays; labels as numbers."""
    place: dict[bytes, int] = {}
    out = {c: np.frombuffer(b"".join(part.column(c).to_pylist()), dtype=np.uint64).reshape(part.num_rows, -1) for c in ("odd", "parity")}
    out |= {"key": part.column("key").to_pylist(), "n": part.column("n").to_numpy()}
    out["label"] = np.array([place.setdefault(x, len(place)) for x in part.column("label").to_pylist()], dtype=np.int64)
    if "bands" in part.schema.names:
        out["bands"] = part.column("bands").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
        out["tile"] = part.column("tile").to_numpy()
    return out


def _by_group(names: list[str], work, out: pa.Schema):
    """Applies ``work`` to the rows of each group; groups lie one after another, and one and a batch are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in _with_end(batches):
            held = [x for x in (rest, batch) if x is not None]
            rest = None
            table = pa.Table.from_batches(held).combine_chunks() if held else None
            if table is None or not table.num_rows:
                continue
            whole = table.to_batches()[0]
            keys = np.stack([whole.column(c).to_numpy(zero_copy_only=False) for c in names])
            heads = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
            stops = np.append(heads[1:], whole.num_rows)
            if batch is not None:  # the last group may go on in the next batch
                rest, heads, stops = whole.slice(int(heads[-1])), heads[:-1], stops[:-1]
            rows = [x for a, b in zip(heads.tolist(), stops.tolist(), strict=True) if b - a > 1 for x in work(whole.slice(a, b - a))]
            yield pa.RecordBatch.from_pylist([dict(zip(out.names, x, strict=True)) for x in rows], schema=out)

    return run


def _nearest(part: pa.RecordBatch) -> Iterator[tuple[bytes, bytes, float]]:
    """The partner that looks nearest of each member that may be linked to one."""
    members = _members(part)
    for first in range(0, part.num_rows, STEP):
        possible, apart = _near(members, slice(first, first + STEP), slice(0, part.num_rows))
        best = np.where(possible, apart, np.inf).argmin(axis=1)
        for i in np.flatnonzero(possible.any(axis=1)).tolist():
            yield members["key"][first + i], members["key"][best[i]], float(apart[i, best[i]])


def _pairs(members: dict, band: int, one: bool) -> Iterator[tuple[int, np.ndarray]]:
    """Each member with those that it may be linked to, from two tiles or within one; a pair that shares several bands
    is only looked at in the first."""
    tile, bands = members["tile"], members["bands"]
    n = len(tile)
    edge = n if one else int(np.searchsorted(tile, tile[-1]))  # the second tile's members come last
    for first in range(0, edge, STEP):
        a = slice(first, min(first + STEP, edge))
        b = slice(0, n) if one else slice(edge, n)
        possible, _ = _near(members, a, b)
        if one:
            possible &= np.arange(a.start, a.stop)[:, None] < np.arange(n)[None, :]
        i, j = np.nonzero(possible)
        shared = bands[first + i] == bands[b.start + j]
        possible[i, j] = bands[b.start + j, shared.argmax(axis=1)] == band
        for k in np.flatnonzero(possible.any(axis=1)).tolist():
            yield first + k, b.start + np.flatnonzero(possible[k])


def _wanted(part: pa.RecordBatch) -> Iterator[tuple]:
    """The members of a group that may be linked to another one."""
    group = tuple(part.column(c)[0].as_py() for c in ("band", "low", "high"))
    members = _members(part)
    if group[1] != group[2] and members["tile"][0] == members["tile"][-1]:
        return
    chosen = np.zeros(part.num_rows, dtype=bool)
    for i, js in _pairs(members, group[0], group[1] == group[2]):
        chosen[i] = True
        chosen[js] = True
    for i in np.flatnonzero(chosen).tolist():
        yield (*group, members["key"][i])


def _links(part: pa.RecordBatch) -> Iterator[tuple[bytes, bytes]]:
    """Links between members of a group, confirmed on the full sets; of those that join the same labels only the first,
    so there are fewer than members."""
    band, low, high = (part.column(c)[0].as_py() for c in ("band", "low", "high"))
    members = _members(part)
    if low != high and members["tile"][0] == members["tile"][-1]:
        return
    sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in part.column("items")]
    parent = list(range(int(members["label"].max()) + 1))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    label = members["label"].tolist()
    for i, js in _pairs(members, band, low == high):
        open_ = [j for j in js.tolist() if root(label[j]) != root(label[i])]
        for first in range(0, len(open_), STEP):
            some = open_[first : first + STEP]
            sizes = np.array([len(sets[j]) for j in some])
            items = np.concatenate([sets[j] for j in some])
            place = np.minimum(np.searchsorted(sets[i], items), len(sets[i]) - 1)
            common = np.add.reduceat((sets[i][place] == items).astype(np.int64), np.cumsum(sizes) - sizes)
            linked = 100 * common >= PERCENT * (len(sets[i]) + sizes - common)
            for j in np.array(some)[linked].tolist():
                if root(label[i]) != root(label[j]):
                    parent[root(label[j])] = root(label[i])
                    yield members["key"][i], members["key"][j]


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Full sets, each in order."""
    for whole in batches:
        for batch in slices(iter([whole])):
            found, rows = shingles(*utf8(batch.column("text")))
            found = found[np.lexsort((found, rows))]
            stops = np.searchsorted(rows, np.arange(batch.num_rows), side="right")
            items = [x.tobytes() for x in np.split(found, stops[:-1])]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(items, pa.binary())], names=["key", "items"])


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose full shingle sets are similar enough."""
    for whole in batches:
        for batch in slices(slices(iter([whole]), "text_a"), "text_b"):
            n = batch.num_rows
            one, row_a = shingles(*utf8(batch.column("text_a")))
            two, row_b = shingles(*utf8(batch.column("text_b")))
            keyed = mix(np.concatenate([one, two]) + np.concatenate([row_a, row_b]).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
            held, count = np.unique(keyed, return_counts=True)
            twice = held[count == 2]
            common = np.bincount(row_a[np.isin(keyed[: len(one)], twice)], minlength=n)
            union = np.bincount(row_a, minlength=n) + np.bincount(row_b, minlength=n) - common
            linked = 100 * common >= PERCENT * union
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked)], names=["a", "b", "linked"])


def groups(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """(key, label) of every shingle set that is linked to another one; ``rows`` are the stored signatures.

    Sets are compared once each, however many documents have them. First each set meets the one that looks nearest to
    it in its buckets, in tiles of bounded size. Buckets that then still hold several components are compared whole:
    all tiles of the members outside of the bucket's largest component with all its tiles, two tiles a task, and each
    pair in the first band it shares only. Sets that the sketches cannot rule out meet again with their full sets, and
    the task that holds them confirms the links, so pairs are never written down; it keeps as many links as join
    components. Nothing is linked by an estimate, and no pair of a bucket is left out.
    """
    reps = rows.where("key is not null").groupBy("key").agg(*[F.first(c).alias(c) for c in ("digest", "n", "odd", "parity", "bands")])
    reps = stage(reps, "near-sets")
    banded = reps.select("key", "n", F.explode("bands").alias("band"))
    crowded = stage(banded.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "near-buckets")
    members = stage(banded.join(crowded, "band"), "near-members")
    texts = _texts(documents, reps.join(members.select("key").distinct(), "key", "left_semi").select("key", "digest"))
    sketches = reps.select("key", "odd", "parity", "bands")
    near = stage(_first_pairs(members, sketches), "near-pairs")
    sides = [texts.select(F.col("key").alias(c), F.col("text").alias(f"text_{c}")) for c in ("a", "b")]
    judged = near.join(sides[0], "a").join(sides[1], "b").select("a", "b", "text_a", "text_b").mapInArrow(_confirm, "a binary, b binary, linked boolean")
    links = stage(judged.where("linked").select("a", "b"), "near-links")
    rest = stage(_other_links(members, sketches, texts, components(links)), "near-links")
    return components(links.unionByName(rest))


def _texts(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """A text for each wanted set, found by its digest; copies are reduced to one before they are shuffled."""
    digest = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    once = documents.select(digest.alias("digest"), "text").groupBy("digest").agg(F.first("text").alias("text"))
    return stage(once.join(wanted, "digest").select("key", "text"), "near-texts")


def _first_pairs(members: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs a < b of each set and the one that looks nearest in its tiles."""
    tile = F.pmod(F.xxhash64("key"), F.ceil(F.col("size") / TILE).cast("int")).cast("int")
    placed = members.select("band", "key", "n", tile.alias("tile"), F.col("key").alias("label")).join(sketches.drop("bands"), "key")
    out = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("far", pa.float64())])
    near = placed.repartition("band", "tile").sortWithinPartitions("band", "tile").mapInArrow(_by_group(["band", "tile"], _nearest, out), "a binary, b binary, far double")
    near = near.groupBy("a").agg(F.min_by("b", F.struct("far", "b")).alias("b"))
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _other_links(members: DataFrame, sketches: DataFrame, texts: DataFrame, labels: DataFrame) -> DataFrame:
    """Confirmed links between sets of different labels that share a band."""
    named = stage(members.join(labels, "key", "left").select("band", "key", "n", F.coalesce("label", "key").alias("label")), "near-named")
    counts = named.groupBy("band", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"))
    weight = F.struct("c", "w", "label")
    mixed = counts.groupBy("band").agg(F.count(F.lit(1)).alias("kinds"), F.sum("c").alias("c"), F.sum("w").alias("w"), F.max(weight).alias("main")).where("kinds > 1")

    def tiles(c, w):  # of bounded members and elements
        return F.greatest(F.ceil(c / TILE), F.ceil(w / TILE_ITEMS)).cast("int")

    mixed = stage(mixed.select("band", F.col("main.label").alias("main"), tiles(F.col("main.c"), F.col("main.w")).alias("mains"), tiles(F.col("c") - F.col("main.c"), F.col("w") - F.col("main.w")).alias("others")), "near-mixed")
    is_main = F.col("label") == F.col("main")
    own = F.when(is_main, F.pmod(F.xxhash64("key"), "mains")).otherwise(F.col("mains") + F.pmod(F.xxhash64("key"), "others")).cast("int")
    meets = F.when(is_main, F.sequence(F.col("mains"), F.col("mains") + F.col("others") - 1)).otherwise(F.sequence(F.lit(0), F.col("mains") + F.col("others") - 1))
    home = named.join(mixed, "band").withColumn("tile", own).select("band", "key", "n", "label", "tile", F.explode(meets).alias("with"))
    home = stage(home.select("band", F.least("tile", "with").alias("low"), F.greatest("tile", "with").alias("high"), "tile", "key", "n", "label"), "near-tiles")
    group = ["band", "low", "high"]

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(*group).sortWithinPartitions(*group, "tile")

    out = pa.schema([("band", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("key", pa.binary())])
    wanted = stage(dealt(home.join(sketches, "key")).mapInArrow(_by_group(group, _wanted, out), "band long, low int, high int, key binary"), "near-wanted")
    sets = texts.join(wanted.select("key").distinct(), "key", "left_semi").mapInArrow(_sets, "key binary, items binary")
    full = wanted.join(home, [*group, "key"]).join(sketches, "key").join(stage(sets, "near-items"), "key")
    out = pa.schema([("a", pa.binary()), ("b", pa.binary())])
    found = dealt(full.select(*group, "tile", "key", "n", "label", "odd", "parity", "bands", "items")).mapInArrow(_by_group(group, _links, out), "a binary, b binary")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    Documents are linked if their sets of 5-word shingles have a similarity of 0.75 or more; a component's id is
    the smallest doc_id in it. Null and empty texts and texts of white space have an empty set, are linked with
    nothing and are their own component. Null ids take part but never name a component that has another id;
    a document is kept if its id is the component's. Repeated rows come out repeatedly.
    """
    rows = stage(signatures(documents), "near-signatures")
    labels = groups(documents, rows)
    named = rows.select("doc_id", "n", "key").join(labels, "key", "left").select("doc_id", "n", F.coalesce("label", "key").alias("label"))
    named = stage(named, "near-rows")
    first = stage(named.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("c")).where("c > 1").select("label", "component_id"), "near-first")
    out = named.join(first, "label", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def one_of_each(documents: DataFrame) -> DataFrame:
    """One document of each component, that with the smallest doc_id, in its own columns. Documents without words
    all stay, as each is a component; rows equal in id and text count as one document."""
    judged = stage(signatures(documents), "near-signatures")
    labels = groups(documents, judged)
    named = stage(judged.select("doc_id", "digest", "key").join(labels, "key", "left").select("doc_id", "digest", F.coalesce("label", "key").alias("label")), "near-rows")
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "digest")
    first = named.where("label is not null").groupBy("label").agg(F.min(rank).alias("r")).select("r.doc_id", "r.digest")
    keep = stage(first.unionByName(named.where("label is null").select("doc_id", "digest")).distinct(), "near-kept")
    names = documents.columns
    at = {c: f"c{i}" for i, c in enumerate(names)}
    digest = F.unhex(F.md5(F.coalesce(F.col(at["text"]), F.lit(""))))
    rows = documents.toDF(*at.values()).withColumn("_digest", digest)
    once = rows.groupBy(at["doc_id"], "_digest").agg(*[F.first(c).alias(c) for n, c in at.items() if n != "doc_id"])
    kept = keep.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_kept"))
    return once.join(kept, (once[at["doc_id"]].eqNullSafe(kept["_id"])) & (once["_digest"] == kept["_kept"]), "left_semi").select(*at.values()).toDF(*names)
