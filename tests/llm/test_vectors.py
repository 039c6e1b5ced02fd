"""Nearest neighbours and whitening against brute force on small tables."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import charpoly, collisions, whitening

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, rank int"


def brute(vectors, most):
    """Query id -> [(distance, id)] over rows (id, vector) that take part."""
    rows = {(i, tuple(v)) for i, v in vectors if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)}
    out = {}
    for i, v in rows:
        near = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(v, w, strict=True))), j) for j, w in rows if j != i and len(w) == len(v))
        out[i, v] = near[:most]
    return out


def floats(rows):
    return [[float(x) for x in np.asarray(r, dtype=np.float32)] for r in rows]


def test_recall_and_scores(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(40, 24))
    points = floats(np.concatenate([centers[rng.integers(0, 40, 2600)] + 0.4 * rng.normal(size=(2600, 24)), rng.normal(size=(400, 24))]))
    rows = list(enumerate(points))
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    asked = df.where("vec_id % 50 = 0")
    found = collisions.nearest(df, asked, 10, tile_rows=700).collect()
    wanted = brute(rows, 10)
    hits = 0
    for i in range(0, 3000, 50):
        mine = sorted((r["rank"], r["score"], r["vec_id"]) for r in found if r["query_id"] == i)
        assert [m[0] for m in mine] == list(range(1, 11))
        assert [m[1:] for m in mine] == sorted(m[1:] for m in mine)
        for _, score, j in mine:
            assert score == pytest.approx(math.dist(points[i], points[j]), rel=1e-12)
        hits += len({m[2] for m in mine} & {j for _, j in wanted[i, tuple(points[i])]})
    assert hits >= 0.95 * 600


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, NAN]), (6, [INF, 1.0]), (7, None), (8, []),
            (None, [1.0, 0.5]), (9, [2.0, 0.0]), (10, [1.0, 0.0, 0.0]), (11, [0.0, 2.0, 0.0]), (12, [3.0, 3.0]), (12, [1.0, 0.0]), (13, [1.0, 2.0, 3.0, 4.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    found = collisions.nearest(df, df, 10).collect()
    wanted = brute(rows, 10)
    got = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    for i in {i for i, _ in wanted}:  # id 12 asks with two vectors
        assert sorted(got.get(i, [])) == sorted(x for (j, _), near in wanted.items() if j == i for x in near)
    assert set(got) == {1, 2, 9, 10, 11, 12}


def by_widening(tile, own, vector, most):
    """One radius after the other, every one counted and verified from the start."""
    n = len(tile.ids)
    projected = np.stack([tile.vectors @ d for d in tile.directions])
    center = tile.directions @ vector
    place = [np.searchsorted(v, c) for v, c in zip(tile.values, center, strict=True)]
    reach = min(most, n) - 1
    ends = [max(abs(v[min(max(p + s, 0), n - 1)] - c) for s in (-reach, reach)) for v, c, p in zip(tile.values, center, place, strict=True)]
    radius, radii = max(float(np.median(ends)) * 2 / collisions.WIDTH, 1e-300), 1
    while True:
        half = radius * collisions.WIDTH / 2
        inside = (projected >= (center - half)[:, None]) & (projected <= (center + half)[:, None])
        rows = np.flatnonzero(inside.sum(axis=0) >= tile.least)
        other = rows[tile.ids[rows] != own]
        apart = tile.vectors[other] - vector
        found = sorted(zip(np.sqrt(np.einsum("ij,ij->i", apart, apart)).tolist(), tile.ids[other].tolist(), strict=True))[:most]
        if len(found) == most and found[-1][0] <= radius or len(rows) == n:
            return found, radii
        radius, radii = radius * collisions.GROWTH, radii + 1


@pytest.mark.parametrize("kind", ["spread", "clusters", "ties", "equal", "few", "huge", "tiny"])
def test_search_ends_at_the_first_radius_that_does(kind):
    rng = np.random.default_rng(11)
    vectors = {
        "spread": rng.normal(size=(1500, 24)), "clusters": np.repeat(rng.normal(size=(30, 24)), 40, axis=0) + 0.01 * rng.normal(size=(1200, 24)), "ties": rng.integers(-2, 3, (900, 5)).astype(float),
        "equal": np.concatenate([np.ones((300, 4)), rng.normal(size=(30, 4))]), "few": rng.normal(size=(7, 5)), "huge": 1e200 * rng.normal(size=(300, 6)), "tiny": 1e-200 * rng.normal(size=(300, 6)),
    }[kind]
    ids = rng.permutation(np.arange(len(vectors)) // 2)
    tile = collisions.Tile(ids, vectors)
    asked = np.unique(np.linspace(0, len(vectors) - 1, 60).astype(int))
    wanted = [by_widening(tile, ids[i], vectors[i], 10) for i in asked]
    counted = []
    count = tile.candidates
    tile.candidates = lambda centers, halves: counted.append(len(centers)) or count(centers, halves)
    got = [x for a in range(0, len(asked), 16) for x in tile.nearest(ids[asked[a : a + 16]], vectors[asked[a : a + 16]], 10)]
    assert got == [found for found, _ in wanted]
    if kind == "spread":  # the radii before the last ones are not counted
        assert sum(counted) <= 3 * len(asked) < sum(radii for _, radii in wanted) / 3


def test_many_equal_vectors_tie_by_id(spark):
    rows = [(i, [1.0, 1.0, 1.0]) for i in range(400)] + [(1000 + i, [float(i), 1.0, 0.0]) for i in range(30)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    found = collisions.nearest(df, df.where("vec_id in (0, 5, 399)"), 10, tile_rows=64).collect()
    for i, wanted in ((0, range(1, 11)), (5, [j for j in range(11) if j != 5]), (399, range(10))):
        assert [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == i] == list(wanted)


def test_no_vectors(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert collisions.nearest(none, none).count() == 0
    assert whitening.whiten(none).count() == 0
    alone = spark.createDataFrame([(100, [1.0, 2.0], 0)], SCHEMA)
    assert collisions.nearest(alone, alone).count() == 0
    assert whitening.whiten(alone).count() == 0


def gram(rows, seed, n=30):
    y = np.array(np.random.default_rng(seed).integers(-9, 10, (n, rows)), dtype=object)
    return [[int(v) for v in r] for r in n * (y.T @ y) - np.outer(y.sum(axis=0), y.sum(axis=0))]


@pytest.mark.parametrize("size", [1, 2, 3, 5, 9])
def test_polynomial_against_exact_determinants(size):
    m = gram(size, size)
    got = charpoly.combined([(p, charpoly.modular(m, p)) for p in charpoly.primes_for(charpoly.bound(m))])
    for x in range(-3, size + 1):
        a = [[Fraction(x * (i == j) - m[i][j]) for j in range(size)] for i in range(size)]
        det = Fraction(1)
        for k in range(size):
            pivot = next((i for i in range(k, size) if a[i][k]), None)
            if pivot is None:
                det = Fraction(0)
                break
            if pivot != k:
                a[k], a[pivot], det = a[pivot], a[k], -det
            det *= a[k][k]
            for i in range(k + 1, size):
                f = a[i][k] / a[k][k]
                a[i] = [u - f * v for u, v in zip(a[i], a[k], strict=True)]
        assert sum(c * x**i for i, c in enumerate(got)) == det


def test_modular_with_a_zero_below_the_diagonal():
    m = [[4, 0, 0, 1], [0, 3, 0, 0], [0, 0, 3, 0], [1, 0, 0, 4]]
    c = charpoly.combined([(p, charpoly.modular(m, p)) for p in charpoly.primes_for(charpoly.bound(m))])
    assert c == [135, -162, 72, -14, 1]  # (x - 3)**3 (x - 5)
    roots = charpoly.largest_roots(c, 16)
    assert [(round(float(r), 12), k) for r, k in roots] == [(5.0, 1), (3.0, 3)]
    v = charpoly.null_vectors(m, *roots[1])
    assert np.allclose(v @ v.T, np.eye(3), atol=1e-14) and np.allclose(np.array(m) @ v.T, 3 * v.T, atol=1e-13)


def test_close_roots_are_told_apart():
    big = 10**20
    m = [[big, 1, 0], [1, big, 0], [0, 0, 7]]
    c = charpoly.combined([(p, charpoly.modular(m, p)) for p in charpoly.primes_for(charpoly.bound(m))])
    roots = charpoly.largest_roots(c, 2)
    assert [k for _, k in roots] == [1, 1] and abs(roots[0][0] - big - 1) < Fraction(1, 1000) and abs(roots[1][0] - big + 1) < Fraction(1, 1000)
    v = np.concatenate([charpoly.null_vectors(m, *r) for r in roots])
    assert np.allclose(np.abs(v), [[math.sqrt(0.5), math.sqrt(0.5), 0]] * 2, atol=1e-15)


def whitened_by_hand(points, most):
    x = np.floor(np.array(points, dtype=np.float64) * 64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    values, vectors = np.linalg.eigh(np.cov(fit.T, bias=True).reshape(len(sums), -1))
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    return n, ((n * x - sums) ** 2).sum(axis=1), (x - sums / n) @ vectors / np.sqrt(values), values


def test_whitening(spark):
    rng = np.random.default_rng(8)
    points = floats(rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)))
    points += [points[0]] * 150  # a third of all rows are one vector
    odd = [(900, None, 0), (901, [1.0] * 5 + [None], 0), (902, [1.0] * 5 + [NAN], 0), (903, [-INF] * 6, 0), (904, [], 0), (905, [1.0, 2.0], 0)]
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(points)] + odd, SCHEMA).repartition(7)
    out = whitening.whiten(df, 4).toPandas()
    n, deviation, wanted, values = whitened_by_hand(points, 4)
    assert len(out) == 450 * 4 and set(out.vec_id) == set(range(450)) and set(out.n) == {n}
    table = out.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    signs = np.sign((table * wanted).sum(axis=0))
    assert np.allclose(table, wanted * signs, atol=1e-9)
    assert out.groupby("vec_id").deviation.first().tolist() == deviation.astype(np.int64).tolist()
    x = np.floor(np.array(points) * 64)
    trace = np.cov(np.unique(x, axis=0).T, bias=True).trace()
    assert np.allclose(out.groupby("component").explained.first(), values / trace, rtol=1e-12)
    assert out.identity_error.nunique() == 1 and out.identity_error[0] < 1e-9


def test_whitening_of_few_dimensions_and_equal_eigenvalues(spark):
    square = [(i, [float(a), float(b), 1.0], 0) for i, (a, b) in enumerate([(1, 0), (-1, 0), (0, 1), (0, -1)])]
    out = whitening.whiten(spark.createDataFrame(square, SCHEMA)).toPandas()
    assert set(out.component) == {1, 2} and len(out) == 8  # the third dimension has no variance
    assert np.allclose(out.explained, 0.5) and out.identity_error.max() < 1e-12
    assert np.allclose((out.whitened**2).groupby(out.vec_id).sum(), 2)


def test_whitening_beyond_a_long(spark):
    rows = [(i, [float(i) * 1e9, float(i % 7)], 0) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    out = whitening.whiten(df).toPandas()
    assert out.deviation.isna().any() and out.identity_error.max() < 1e-9
    exact = {r["vec_id"]: r["x"] for r in df.select("vec_id", whitening.integers("embedding").alias("x")).collect()}
    sums = [sum(v[j] for v in exact.values()) for j in range(2)]
    for i, got in zip(out.vec_id, out.deviation, strict=True):
        true = sum((50 * exact[i][j] - sums[j]) ** 2 for j in range(2))
        assert (math.isnan(got) and true >= 1 << 63) or true == got


def test_exact_sums_of_large_numbers(spark):
    rows = [([(1 << 61) - i, -(1 << 60) + i],) for i in range(100)]
    fit = spark.createDataFrame(rows, "x array<long>").repartition(5)
    n, sums = whitening.exact_sums(fit)
    assert n == 100 and sums == [sum(r[0][j] for r in rows) for j in range(2)]
    _, products = whitening.exact_sums(fit, [3, -5])
    z = [[r[0][0] - 3, r[0][1] + 5] for r in rows]
    assert products == [sum(a * a for a, _ in z), sum(a * b for a, b in z), sum(b * b for _, b in z)]


def test_clashing_columns(spark):
    df = spark.createDataFrame([(i, [float(i % 5), float(i % 3)], 0) for i in range(1, 40)], SCHEMA)
    df = df.withColumns({c: F.lit("own") for c in ("tile", "ask", "asks", "size", "score", "x", "n", "vector")})
    assert collisions.nearest(df, df.where("vec_id = 7")).columns == ["query_id", "rank", "vec_id", "score"]
    assert whitening.whiten(df).count() == 78
