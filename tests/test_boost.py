"""Second-order boosting next to a search of all splits, memberships behind a filter, forecasts from one pass."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import boost, learn, lookup


def rows_of(n, seed, logistic=False):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b, c = rng.choice([None, 1.0, 2.0, 3.5, 7.0, math.nan]), rng.random(), rng.randrange(4)
        y = 3 * (a if a == a and a is not None else -2) + (5 if b > 0.6 else 0) * c + rng.gauss(0, 0.3)
        out.append((a, b, c, float(y > 6) if logistic else y))
    return out


def by_hand(rows, edges, rounds, depth, rate, penalty, logistic):
    """Predictions after every round, splits found by trying all of them."""
    miss = lambda v: v is None or v != v
    bins = [[-1 if miss(v) else sum(e < v for e in edges[j]) for j, v in enumerate(r[:3])] for r in rows]
    y = np.array([r[3] for r in rows])
    base = math.log(y.mean() / (1 - y.mean())) if logistic else y.mean()
    scale = len(y) * (1 if logistic else y.var())
    margin, steps = np.full(len(y), base), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin)) if logistic else margin
        g, h = p - y, p * (1 - p) if logistic else np.ones(len(y))

        def grow(at, level):
            whole, best = g[at].sum() ** 2 / (h[at].sum() + penalty), None
            for j in range(3) if level < depth else ():
                for b in range(len(edges[j]) + 1):
                    for missing_left in (False, True):
                        left = [i for i in at if (missing_left if bins[i][j] < 0 else bins[i][j] <= b)]
                        right = sorted(set(at) - set(left))
                        if not left or not right or min(h[left].sum(), h[right].sum()) < 1 or b not in {bins[i][j] for i in at}:
                            continue
                        gain = g[left].sum() ** 2 / (h[left].sum() + penalty) + g[right].sum() ** 2 / (h[right].sum() + penalty) - whole
                        key = (-round(gain / scale, 10), j, b, missing_left)
                        if -key[0] > 0 and (best is None or key < best[0]):
                            best = (key, left, right)
            if best is None:
                margin[at] += -rate * g[at].sum() / (h[at].sum() + penalty)
            else:
                grow(best[1], level + 1)
                grow(best[2], level + 1)

        grow(list(range(len(y))), 0)
        steps.append(margin.copy())
    return base, steps


@pytest.mark.parametrize("logistic", [False, True])
def test_splits_are_the_best_of_all(spark, logistic):
    rows = rows_of(300, 4, logistic)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a double, b double, c int, y double").repartition(5)
    model = boost.fit_boosted(df, ["a", "b", "c"], "y", rounds=5, depth=3, bins=6, rate=0.5, logistic=logistic)
    base, steps = by_hand(rows, model.edges, 5, 3, 0.5, 1.0, logistic)
    assert model.base == pytest.approx(base)
    got = np.array([r.prediction for r in boost.score_boosted(df, model).orderBy("i").collect()])
    assert got == pytest.approx(1 / (1 + np.exp(-steps[-1])) if logistic else steps[-1])
    if not logistic:
        errors = {r["round"]: r.rmse for r in boost.errors_by_round(df, model, "y").collect()}
        y = np.array([r[3] for r in rows])
        assert [errors[i] for i in range(6)] == pytest.approx([math.sqrt(((y - m) ** 2).mean()) for m in [np.full(300, base), *steps]])
        held = rows_of(300, 5)
        other = spark.createDataFrame(held, "a double, b double, c int, y double")
        unseen = {r["round"]: r.rmse for r in boost.errors_by_round(other, model, "y").collect()}
        assert unseen[5] < 0.35 * unseen[0]  # held-out error
    table = boost.nodes_table(spark, model)
    assert table.filter("feature is null").count() == table.filter("feature is not null").count() + 5


def test_boosting_without_much_to_fit(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (None, 2.0), (3.0, None), (4.0, math.nan)], "a double, y double")
    same = boost.fit_boosted(df, ["a"], "y", rounds=2)
    assert same.trees == [] and [r.prediction for r in boost.score_boosted(df, same).collect()] == [2.0] * 5
    empty = boost.fit_boosted(df.filter("a > 9"), ["a"], "y")
    assert empty.base is None and {r.prediction for r in boost.score_boosted(df, empty).collect()} == {None}
    assert boost.fit_boosted(df.withColumn("y", F.lit(1)), ["a"], "y", logistic=True).base == math.inf
    lone = spark.createDataFrame([(None, 1.0), (None, 1.0), (5.0, 9.0), (5.0, 9.0)], "a double, y double")
    for cuts, edge in ((None, 5.0), ({"a": [1.0]}, None)):  # above all edges only known and missing values are parted
        model = boost.fit_boosted(lone, ["a"], "y", rounds=1, depth=2, rate=1.0, penalty=0.0, edges=cuts)
        assert sorted(r.prediction for r in boost.score_boosted(lone, model).collect()) == [1.0, 1.0, 9.0, 9.0]
        assert [tuple(r)[2:5] for r in boost.nodes_table(spark, model).filter("node = 1").collect()] == [("a", edge, False)]


@pytest.mark.parametrize("most", [1, 4, 1 << 20])
def test_members_behind_a_filter(spark, most):
    rng = random.Random(3)
    rows = [(rng.randrange(4000), rng.choice(["a", "b", None])) for _ in range(5000)] + [(None, "a"), (7, "a"), (7, "a")]
    df = spark.createDataFrame(rows, "k int, s string")
    keys = spark.createDataFrame([(k, "a" if k % 2 else "b", 1) for k in range(0, 3000, 7)] * 2 + [(None, "a", 1), (7, None, 1)], "k int, s string, extra int")
    for on in (["k"], ["k", "s"]):
        want = sorted(map(str, lookup.members(df, keys, on).collect()))
        assert want and sorted(map(str, lookup.members_filtered(df, keys, on, most_blocks=most).collect())) == want
    assert lookup.members_filtered(df, keys.filter("extra = 2"), ["k"]).count() == 0
    assert lookup.members_filtered(df.filter("k < 0"), keys, ["k"]).count() == 0
    with pytest.raises(ValueError):
        lookup.members_filtered(df, keys.withColumn("k", F.col("k").cast("bigint")), ["k"])


def test_the_filter_lets_few_others_pass(spark):
    keys = spark.range(20_000).select((F.col("id") * 3).alias("k"))
    words = lookup.key_filter(keys, ["k"], 8192).scalar()
    mask = lookup._mask(["k"])
    hit = F.get(words, lookup._word(["k"], 8192).cast("int")).bitwiseAND(mask) == mask
    passed = spark.range(60_000).select(F.col("id").alias("k")).filter(hit)
    assert passed.filter("k % 3 = 0").count() == 20_000
    assert passed.filter("k % 3 <> 0").count() < 0.02 * 40_000


def test_rows_fall_out_before_the_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = lookup.members_filtered(spark.range(50_000).withColumnRenamed("id", "k").withColumn("v", F.lit(1)), spark.range(100).withColumnRenamed("id", "k"), ["k"])
        assert out.count() == 100
        lines = out._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    shuffle = next(i for i, line in enumerate(lines) if "Exchange hashpartitioning(k#" in line)
    assert any("Filter" in line and "xxhash64(k#" in line for line in lines[shuffle : shuffle + 6])


def test_forecast_is_least_squares(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(50, 3, (400, 2))
    y = np.roll(x[:, 0], 3) * 2 - np.roll(x[:, 1], 4) + rng.normal(0, 0.1, 400)
    rows = [(i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y))]
    rows[100] = (100, None, rows[100][2], rows[100][3])
    rows[200] = (200, rows[200][1], math.nan, rows[200][3])
    df = spark.createDataFrame(rows, "t int, a double, b double, y double")
    got = {r.split: r for r in learn.forecast(df, ["t"], ["a", "b"], ["y"], window=4, penalty=0.0, block=64).collect()}
    z, goal, place = [], [], []
    for i in range(4, 398):
        w = [v for r in rows[i - 4 : i] for v in r[1:3]]
        if all(v is not None and v == v for v in w):
            z.append([1.0, *w])
            goal.append(rows[i + 2][3])
            place.append(i - 4 < 394 - math.ceil(0.2 * 394))
    z, goal, train = np.array(z), np.array(goal), np.array(place)
    weights = np.linalg.lstsq(z[train], goal[train], rcond=None)[0]
    for name, part in (("train", train), ("test", ~train)):
        assert got[name].n == part.sum()
        assert got[name].rmse == pytest.approx(math.sqrt(((goal - z @ weights)[part] ** 2).mean()), rel=1e-6)
        assert got[name].mean_rmse == pytest.approx(math.sqrt(((goal - goal[train].mean())[part] ** 2).mean()))
    assert learn.forecast(df.filter("t < 3"), ["t"], ["a"], ["y"], window=4).count() == 0
    assert learn.forecast(df.withColumn("a", F.lit(1.0)), ["t"], ["a", "b"], ["y"], window=4, penalty=0.0).count() == 2
