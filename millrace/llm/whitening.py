"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter matrix."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.charpoly import bound, combined, largest_roots, modular, null_vectors, primes_for
from millrace.llm.vectorrows import matrix, whole
from millrace.session import stage

SCALE, OFFSET = 64, 1_000_000
LARGEST = float(1 << 61)  # of an entry times SCALE
COMPONENTS = 16
LIMB = 40


def integers(vector: str) -> Column:
    """floor(64 * c) + 1000000 of every entry as a long; entries beyond 2**55 count as 2**55."""
    return F.transform(vector, lambda c: F.floor(F.least(F.greatest(c.cast("double") * SCALE, F.lit(-LARGEST)), F.lit(LARGEST))).cast("long") + F.lit(OFFSET).cast("long"))


def _limbs(values: list[int]) -> list[list[int]]:
    """Each number in four parts that can be added up as longs."""
    low = (1 << LIMB) - 1
    return [[v >> LIMB * i & low for v in values] for i in range(3)] + [[v >> LIMB * 3 for v in values]]


def _products(x: np.ndarray) -> np.ndarray:
    """Sums of products of every two columns of whole numbers, exact, by the quickest kind of number that is."""
    top = int(np.abs(x).max(initial=0)) ** 2 * max(len(x), 1)
    kind = np.float64 if top < 1 << 53 else np.int64 if top < 1 << 63 else object
    y = x.astype(kind)
    return (y.T @ y).astype(np.int64 if kind is np.float64 else kind).astype(object)


def _sums(center: list[int] | None):
    """Per task: with a centre, the sums of products of all pairs of centred columns; without, of the columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("x"), np.int64)
            if center is None:
                new = x.astype(object).sum(axis=0) if int(np.abs(x).max(initial=0)) * len(x) >= 1 << 63 else x.sum(axis=0).astype(object)
            else:
                new = _products(_apart(x, center))[np.triu_indices(x.shape[1])]
            total, rows = new if total is None else total + new, rows + len(x)
        if total is not None:
            values = [rows, *(int(v) for v in total)]
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(total))), *map(pa.array, _limbs(values))], names=["i", "l0", "l1", "l2", "l3"])

    return run


def _apart(x: np.ndarray, center: list[int]) -> np.ndarray:
    at = np.array(center, dtype=object)
    if max(map(abs, center), default=0) + int(np.abs(x).max(initial=0)) < 1 << 62:
        return x - at.astype(np.int64)
    return x.astype(object) - at


def exact_sums(fit: DataFrame, center: list[int] | None = None) -> tuple[int, list[int]]:
    """Number of rows, and the exact sums of their entries or, around a centre, of the products of any two (upper
    triangle). Tasks add up their own rows; the driver gets one number for each dimension or pair of them."""
    parts = fit.select("x").mapInArrow(_sums(center), "i long, l0 long, l1 long, l2 long, l3 long")
    found = parts.groupBy("i").agg(*[F.sum(f"l{k}") for k in range(4)]).collect()
    values = {r[0]: sum(int(v) << LIMB * k for k, v in enumerate(r[1:])) for r in found}
    return values.pop(-1, 0), [values[i] for i in sorted(values)]


def scatter(fit: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """n, S and the integer matrix n * sum((x - c)(x - c)') - (S - n c)(S - n c)' = n**2 V, around the rounded mean c."""
    n, sums = exact_sums(fit)
    if not n:
        return 0, [], []
    center = [(2 * s + n) // (2 * n) for s in sums]
    _, upper = exact_sums(fit, center)
    size, rest = len(sums), [s - n * c for s, c in zip(sums, center, strict=True)]
    out = [[0] * size for _ in range(size)]
    for k, (i, j) in enumerate(zip(*np.triu_indices(size), strict=True)):
        out[i][j] = out[j][i] = n * upper[k] - rest[i] * rest[j]
    return n, sums, out


def characteristic(spark: SparkSession, integer: list[list[int]]) -> list[int]:
    """Coefficients of the characteristic polynomial, lowest first; the primes are shared out over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            primes = batch.column("p").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(primes), pa.array([modular(integer, p) for p in primes], pa.list_(pa.int64()))], names=["p", "c"])

    primes = primes_for(bound(integer))
    tasks = min(len(primes), spark.sparkContext.defaultParallelism)
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(primes)], "i long, p long").repartitionByRange(tasks, "i").select("p")
    return combined([(r[0], r[1]) for r in rows.mapInArrow(run, "p long, c array<long>").collect()])


def components(spark: SparkSession, integer: list[list[int]], most: int = COMPONENTS) -> list[tuple[Fraction, np.ndarray]]:
    """Eigenvalues that are not 0 with their unit vectors, the largest first, at most ``most``; a task for each root."""
    if not any(integer[i][i] for i in range(len(integer))):
        return []
    divisor = math.gcd(*(x for row in integer for x in row))
    reduced = [[x // divisor for x in row] for row in integer]
    roots = largest_roots(characteristic(spark, reduced), most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, up, down, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = null_vectors(reduced, Fraction(int(up), int(down)), copies)
                yield pa.RecordBatch.from_arrays([pa.array([i] * copies), pa.array(range(copies)), pa.array(found.tolist(), pa.list_(pa.float64()))], names=["i", "copy", "v"])

    asked = [(i, str(root.numerator), str(root.denominator), copies) for i, (root, copies) in enumerate(roots)]
    rows = spark.createDataFrame(asked, "i long, up string, down string, copies long").repartitionByRange(len(asked), "i")
    vectors = sorted((r[0], r[1], r[2]) for r in rows.mapInArrow(run, "i long, copy long, v array<double>").collect())
    return [(roots[i][0] * divisor, np.array(v)) for i, _, v in vectors][:most]


class Whitening:
    """What a fit has found: n, S, and for each component its vector over the root of its eigenvalue."""

    def __init__(self, n: int, sums: list[int], integer: list[list[int]], found: list[tuple[Fraction, np.ndarray]]):
        self.n, self.sums = n, sums
        trace = sum(integer[i][i] for i in range(len(integer)))
        self.explained = [float(e / trace) for e, _ in found]
        self.axes = np.array([v / math.sqrt(e / n**2) for e, v in found]).reshape(len(found), len(sums))

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact."""
        top = max(int(np.abs(x).max(initial=0)) * self.n, max(map(abs, self.sums)))
        kind = np.int64 if top < 1 << 62 else object
        return x.astype(kind) * self.n - np.array(self.sums, dtype=kind)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return (centred.astype(np.float64) / self.n) @ self.axes.T

    def deviations(self, centred: np.ndarray) -> list[int | None]:
        """Sums of squares, exact; null beyond a long."""
        if int(np.abs(centred).max(initial=0)) ** 2 * centred.shape[1] < 1 << 63:
            return (centred.astype(np.int64) ** 2).sum(axis=1).tolist()
        exact = [sum(int(v) ** 2 for v in row) for row in centred]
        return [v if v < 1 << 63 else None for v in exact]


def _identity_error(fit: DataFrame, model: Whitening) -> float | None:
    """The largest entry of the covariance of the whitened fit list, minus the identity."""
    k = len(model.axes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first, rows = np.zeros((k, k)), np.zeros(k), 0
        for batch in batches:
            if batch.num_rows:
                w = model.whitened(model.centred(matrix(batch.column("x"), np.int64)))
                total, first, rows = total + w.T @ w, first + w.sum(axis=0), rows + len(w)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(range(k * k + k)), pa.array(np.concatenate([total.reshape(-1), first]))], names=["i", "v"])

    if not k:
        return None
    sums = dict(map(tuple, fit.select("x").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v")).collect()))
    values = np.array([sums[i] for i in range(k * k + k)]) / model.n
    mean = values[k * k :]
    return float(np.abs(values[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def whiten(embeddings: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error, a row for each vector and component.

    Entries c become whole numbers x = floor(64 c) + 1000000. The fit list holds each x vector once, so a vector that
    very many rows have is reduced before it is shuffled and counts once; statistics are exact. Rows whose vector is
    null or empty, or holds null or non-finite entries, are dropped, and so are vectors of another length than most of
    the fit list has (the longer of two equally frequent ones). Repeated rows come out repeatedly, a null vec_id stays.
    Components with an eigenvalue of 0 are left out, as nothing can be divided by its root: with one x vector only, or
    an empty table, there are no rows. ``deviation`` is null where it is larger than a long. No other column is read.
    """
    spark = embeddings.sparkSession
    rows = embeddings.where(whole("embedding")).select("vec_id", integers("embedding").alias("x")).where(F.size("x") > 0)
    fit = stage(rows.select("x").distinct(), "whitening-fit")
    sizes = fit.groupBy(F.size("x").alias("size")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), F.desc("size")).head()
    size = sizes["size"] if sizes else 0
    fit, rows = fit.where(F.size("x") == size), rows.where(F.size("x") == size)
    n, sums, integer = scatter(fit)
    model = Whitening(n, sums, integer, components(spark, integer, most))
    error, k = _identity_error(fit, model), len(model.axes)
    kind = embeddings.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            centred = model.centred(matrix(batch.column("x"), np.int64))
            each = pa.array(np.repeat(np.arange(batch.num_rows), k))
            columns = [
                batch.column("vec_id").take(each),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), batch.num_rows)),
                pa.array(np.full(batch.num_rows * k, n)),
                pa.array(model.deviations(centred), pa.int64()).take(each),
                pa.array(model.whitened(centred).reshape(-1)),
                pa.array(np.tile(np.array(model.explained), batch.num_rows)),
                pa.array(np.full(batch.num_rows * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
