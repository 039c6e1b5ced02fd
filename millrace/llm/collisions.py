"""Nearest neighbours by counting collisions of single projections (query-aware hashing).

A row and a query collide in one projection if their projected values lie within a window centred on the query.
Windows widen by virtual rehashing: nothing is hashed anew, the window only takes more places of the projection's
sorted array. A row that collides in enough of the projections is a candidate, and its distance is computed exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.vectorrows import matrix, whole
from millrace.session import stage

RATIO = 2.0  # approximation ratio the number of projections and the threshold are worked out for
WIDTH = math.sqrt(8 * RATIO**2 * math.log(RATIO) / (RATIO**2 - 1))  # of a window at radius 1
GROWTH = math.sqrt(2.0)
MISS = 1 / math.e  # chance of the method's bound
FALSE_ROWS = 100  # false candidates expected at the bound
TILE_ROWS, LEAST_ROWS = 65_536, 1_024
CELLS = 1 << 17  # queries times rows that are counted at a time
ROUGH_LOW, ROUGH_HIGH, ROUGH_ERROR = 1e-20, 1e30, 2.4e-7  # squared lengths at which 32-bit products do, and how far off they are for each entry
MOST_STEPS = 2_400  # from the least radius beyond the largest number


def _within(half: float) -> float:
    return math.erf(half / math.sqrt(2))


def plan(rows: int) -> tuple[int, int]:
    """How many projections a tile of so many rows has, and how many collisions make a candidate."""
    near, far = _within(WIDTH / 2), _within(WIDTH / 2 / RATIO)
    spread, miss = math.sqrt(math.log(2 / min(1.0, FALSE_ROWS / max(rows, 1)))), math.sqrt(math.log(1 / MISS))
    count = math.ceil((spread + miss) ** 2 / (2 * (near - far) ** 2))
    share = (spread * near + miss * far) / (spread + miss)
    return count, math.ceil(share * count)


@cache
def _directions(count: int, size: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(20_231)).standard_normal((count, size))


class Tile:
    """The rows of a tile: their vectors and, for each projection, the sorted values and every row's place among them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.count, self.least = plan(len(ids))
        self.directions = _directions(self.count, vectors.shape[1])
        self.values = np.empty((self.count, len(ids)))
        self.places = np.empty((self.count, len(ids)), dtype=np.min_scalar_type(len(ids)))
        for i, direction in enumerate(self.directions):
            projected = vectors @ direction
            owners = np.argsort(projected, kind="stable")
            self.values[i] = projected[owners]
            self.places[i, owners] = np.arange(len(ids))
        self.squares = np.einsum("ij,ij->i", vectors, vectors)
        self.largest = float(self.squares.max())
        self.rough = vectors.astype(np.float32) if ROUGH_LOW < self.largest < ROUGH_HIGH else None
        self.hint = 0.0  # how far the last place of the query before was; it saves counts and decides nothing

    def candidates(self, centers: np.ndarray, halves: np.ndarray) -> np.ndarray:
        """For each query the rows whose places lie in enough of the windows."""
        low = np.stack([np.searchsorted(v, c, side="left") for v, c in zip(self.values, (centers - halves[:, None]).T, strict=True)])
        high = np.stack([np.searchsorted(v, c, side="right") for v, c in zip(self.values, (centers + halves[:, None]).T, strict=True)])
        kind = self.places.dtype
        n = len(self.ids)
        first, size = low.astype(kind), (high - low).astype(kind)
        away, inside = np.empty((len(centers), n), dtype=kind), np.empty((len(centers), n), dtype=bool)
        counts = np.zeros((len(centers), n), dtype=np.min_scalar_type(self.count))
        for i in range(self.count):
            np.subtract(self.places[i], first[i][:, None], out=away)  # places below the window wrap around
            np.less(away, size[i][:, None], out=inside)
            np.add(counts, inside.view(np.uint8), out=counts)
        return counts >= self.least

    def best(self, own, vector: np.ndarray, rows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``most`` nearest of the rows of another id and how far they are, nearest first, ties by id.

        Of many rows a rough distance first rules out those that are too far for certain."""
        square = float(np.einsum("i,i", vector, vector))
        if len(rows) > 4 * most + len(vector) and self.rough is not None and square < ROUGH_HIGH:
            apart = self.squares[rows] - 2 * (self.rough[rows] @ vector.astype(np.float32))
            own_rows = self.ids[rows] == own
            apart[own_rows] = np.inf
            if len(rows) - own_rows.sum() > most:
                limit = np.partition(apart, most - 1)[most - 1] + ROUGH_ERROR * (len(vector) + 8) * (self.largest + square)
                rows = rows[apart <= limit]
        rows = rows[self.ids[rows] != own]
        apart = self.vectors[rows] - vector
        far = np.sqrt(np.einsum("ij,ij->i", apart, apart))
        order = np.lexsort((self.ids[rows], far))[:most]
        return rows[order], far[order]

    def nearest(self, owns: np.ndarray, vectors: np.ndarray, most: int) -> list[list[tuple[float, object]]]:
        """For each query the ``most`` nearest rows found of another id, nearest first.

        The first radius is taken from how far the ``most``-th places around the query are; it then widens by
        ``GROWTH`` at a time. The search ends at the first radius within which that many verified rows lie, so every
        row as near as the last one found has been under windows in which it collides often enough with a chance of
        0.97 by the method's bound; it also ends when every row is verified.

        A wider radius has all the candidates of a narrower one. So the radius at which the search ends is found by
        halving the steps in question, which begin near the end of the query before, and most queries need one count.
        """
        n = len(self.ids)
        centers = np.stack([self.directions @ v for v in vectors])
        place = np.stack([np.searchsorted(v, c) for v, c in zip(self.values, centers.T, strict=True)], axis=1)
        reach = min(most, n) - 1
        each = np.arange(self.count)
        ends = np.stack([np.abs(self.values[each, np.clip(place + s, 0, n - 1)] - centers) for s in (-reach, reach)])
        starts = np.maximum(np.median(ends.max(axis=0), axis=1) * 2 / WIDTH, 1e-300)
        widest = np.maximum(np.abs(self.values[:, 0] - centers), np.abs(self.values[:, -1] - centers)).max(axis=1) * 2 / WIDTH
        with np.errstate(all="ignore"):
            steps = np.ceil(np.log(np.maximum(widest / starts, 1.0)) / math.log(GROWTH)) + 2
        steps = np.minimum(np.nan_to_num(steps, nan=MOST_STEPS), MOST_STEPS).astype(int).tolist()
        searches = [_Steps(s, k, self.hint) for s, k in zip(starts, steps, strict=True)]
        open_ = list(range(len(searches)))
        while open_:
            halves = np.array([searches[q].radius * WIDTH / 2 for q in open_])
            chosen = self.candidates(centers[open_], halves)
            for q, mask in zip(open_, chosen, strict=True):
                rows = np.flatnonzero(mask)
                searches[q].judge(*self.best(owns[q], vectors[q], rows, most), most, len(rows) == n)
            open_ = [q for q in open_ if not searches[q].done]
        if len(searches[-1].far):
            self.hint = float(searches[-1].far[-1])
        return [list(zip(s.far.tolist(), self.ids[s.rows], strict=True)) for s in searches]


class _Steps:
    """The search of a query for the first radius at which it may end, among ``steps`` widenings of ``start``; at the
    last one every row is a candidate."""

    def __init__(self, start: float, steps: int, hint: float):
        with np.errstate(over="ignore"):
            self.radii = np.cumprod(np.concatenate([[start], np.full(steps, GROWTH)]))
        self.failed, self.ended = -1, steps + 1  # the widest radius known not to do, the narrowest that does
        self.at = min(int(np.searchsorted(self.radii, hint)), steps)
        self.rows = self.far = np.empty(0)
        self.done, self.leap = False, 1

    @property
    def radius(self) -> float:
        return float(self.radii[self.at])

    def judge(self, rows: np.ndarray, far: np.ndarray, most: int, every: bool) -> None:
        """Takes what the candidates of the radius are worth and chooses the next one to try."""
        last = float(far[-1]) if len(far) >= most else math.inf
        reaches = int(np.searchsorted(self.radii, last))  # the first radius as wide as the last row found is far
        if last <= self.radius or every or self.at + 1 == len(self.radii):
            self.ended, self.rows, self.far = self.at, rows, far
            # a narrower radius finds no nearer rows; if every row is verified and too far, it has nothing to add
            self.failed = max(self.failed, min(reaches, self.at) - 1)
            self.at = self.failed + 1 if self.leap else (self.failed + self.ended) // 2
            self.leap = 0
        else:
            self.failed = self.at
            above = min(self.ended, len(self.radii)) - 1
            if self.ended < len(self.radii):
                self.at, self.leap = (self.failed + self.ended) // 2, 0
            elif reaches <= above:
                self.at, self.leap = max(reaches, self.at + 1), 0  # these rows do there at the latest
            else:
                self.at, self.leap = min(self.at + max(self.leap, 1), above), 2 * max(self.leap, 1)
        self.done = self.failed + 1 >= self.ended


def _search(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a tile come first, then its queries; only the tile and a batch of queries are held."""
        at, parts, tile = None, [], None
        for batch in batches:
            where = batch.column("tile").to_numpy()
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((where[1:] != where[:-1]) | (asks[1:] != asks[:-1])) + 1
            found: list[tuple] = []
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                piece = batch.slice(a, b - a)
                if where[a] != at:
                    at, parts, tile = where[a], [], None
                ids, vectors = piece.column("vec_id").to_numpy(zero_copy_only=False), matrix(piece.column("vector"))
                if not asks[a]:
                    parts.append((ids, vectors))
                    continue
                if parts:
                    tile, parts = Tile(*(np.concatenate(x) for x in zip(*parts, strict=True))), []
                if tile is not None:
                    keys = piece.column("ask").to_numpy()
                    some = max(1, CELLS // len(tile.ids))
                    for q in range(0, len(ids), some):
                        part = slice(q, q + some)
                        for key, own, rows in zip(keys[part], ids[part], tile.nearest(ids[part], vectors[part], most), strict=True):
                            found += [(key, own, d, near) for d, near in rows]
            kind = batch.schema.field("vec_id").type
            columns = list(zip(*found, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), kind, pa.float64(), kind), strict=True)], names=["ask", "query_id", "score", "vec_id"]
            )

    return run


def nearest(vectors: DataFrame, queries: DataFrame, most: int = 10, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``most`` rows of ``vectors`` found nearest to each row of ``queries``.

    Both hold vec_id (a whole number) and embedding. Rows are dealt into tiles by a hash of the whole row, at most
    about ``tile_rows`` each, and a query visits all tiles: a tile's arrays are built once and queries stream past
    them. A tile's windows stop at the nearest rows of that tile, which lie no nearer than those of all. Small tables
    get smaller tiles, so that all tasks have work. Scores are Euclidean distances in double precision; ties go to
    the smaller vec_id.

    Vectors that are null, zero, or hold null or non-finite entries, and rows without a vec_id, take no part, as rows
    or as queries. Rows equal in id and vector count once; an id with several vectors has each of them as a row, and
    as a query of its own. A row never finds its own id. Vectors of different lengths do not meet. With fewer
    candidates than ``most`` all are returned; a query without any has no rows. An empty table gives an empty one.
    """
    sound = F.col("vec_id").isNotNull() & whole("embedding") & F.exists("embedding", lambda x: x != 0)
    kept = [df.where(sound).select("vec_id", F.col("embedding").alias("vector")) for df in (vectors, queries)]
    rows = stage(kept[0].dropDuplicates(["vec_id", "vector"]), "near-vectors")
    asks = stage(kept[1].dropDuplicates(["vec_id", "vector"]).withColumn("ask", F.monotonically_increasing_id()), "near-queries")
    sizes = rows.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = F.greatest(F.ceil(F.col("n") / tile_rows), F.least(F.ceil(F.col("n") / min(LEAST_ROWS, tile_rows)), F.lit(least)))
    tiles = sizes.select("size", wanted.cast("int").alias("tiles"))  # one row for each length of vectors
    dealt = rows.join(tiles, F.size("vector") == F.col("size")).select("vec_id", "vector", F.lit(None).cast("long").alias("ask"), "size", F.pmod(F.xxhash64("vec_id", "vector"), "tiles").cast("int").alias("part"))
    sent = asks.join(tiles, F.size("vector") == F.col("size")).select("vec_id", "vector", "ask", "size", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("part"))
    both = dealt.unionByName(sent).withColumn("asks", F.col("ask").isNotNull()).withColumn("tile", F.shiftleft(F.col("size").cast("long"), 32) + F.col("part")).drop("size", "part")
    kind = vectors.schema["vec_id"].dataType.simpleString()
    found = both.repartition("tile").sortWithinPartitions("tile", "asks").mapInArrow(_search(most), f"ask long, query_id {kind}, score double, vec_id {kind}")
    place = F.row_number().over(Window.partitionBy("ask").orderBy("score", "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= most).select("query_id", "rank", "vec_id", "score")
