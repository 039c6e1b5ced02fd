"""Ordered scans: cut into many buckets they must equal one plain pass."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import ordered
from millrace.operators.quantiles import exact_quantiles, quantile_table
from millrace.operators.sample import batches, exact_split, hash_split, sequential_split, shuffle_rows, train_test


@pytest.fixture(scope="module")
def hot(spark):
    """20,000 rows, a third of them under one key; ties, gaps and NULL keys."""
    rng = random.Random(5)
    rows = []
    for i in range(20_000):
        key = "hot" if i % 3 == 0 else rng.choice(["a", "b", "c", "z", None])
        at = rng.randrange(40) if rng.random() < 0.5 else 7
        rows.append((i, key, at, rng.random() if rng.random() < 0.3 else None, rng.randrange(9)))
    frame = pd.DataFrame(rows, columns=["id", "k", "at", "v", "w"])
    schema = "id bigint, k string, at bigint, v double, w bigint"
    return spark.createDataFrame(rows, schema).repartition(5).persist(), frame


def expected_scan(frame, by_key):
    frame = frame.sort_values(["at", "id"]).copy()
    frame["kk"] = frame.k.fillna("") if by_key else ""
    frame["rank"] = frame.groupby("kk").cumcount() + 1
    frame["run"] = frame.groupby("kk").w.cumsum()
    return dict(zip(frame.id, zip(frame["rank"], frame["run"])))


@pytest.mark.parametrize("by_key", [False, True])
@pytest.mark.parametrize("rows_per_bucket", [97, 1000, 10**9])
def test_scan(hot, by_key, rows_per_bucket):
    df, frame = hot
    got = ordered.scan(df, ["at", "id"], ["k"] if by_key else [], sums={"run": "w"}, rows_per_bucket=rows_per_bucket)
    assert {r.id: (r["rank"], r.run) for r in got.collect()} == expected_scan(frame, by_key)


def test_buckets_split_a_hot_key(hot):
    df, _ = hot
    bucketed = ordered.range_buckets(df, ["k"], ["at", "id"], rows_per_bucket=500)
    sizes = [r[1] for r in bucketed.groupBy(ordered.BUCKET).count().collect()]
    assert 30 <= len(sizes) <= 40 and max(sizes) < 4 * 500


def test_source_is_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def watched(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    df = spark.range(5000).selectExpr("id", "id % 3 as k", "if(id % 4 = 0, null, id) as v").mapInPandas(watched, "id long, k long, v double")
    assert ordered.scan(df, ["id"], ["k"], sums={"s": "id"}, rows_per_bucket=300).count() == 5000
    assert seen.value == 5000
    assert ordered.fill_within_key(df, "k", ["id"], ["v"], rows_per_bucket=300).filter("v is null").count() == 0
    assert seen.value == 10_000


@pytest.mark.parametrize("rows_per_bucket", [97, 10**9])
def test_fill(hot, rows_per_bucket):
    df, frame = hot
    frame = frame.sort_values(["at", "id"])
    want = frame.assign(k=frame.k.fillna("")).groupby("k").v.transform(lambda x: x.ffill().bfill())
    want = dict(zip(frame.id, want))
    got = ordered.fill_within_key(df, "k", ["at", "id"], ["v"], rows_per_bucket=rows_per_bucket)
    assert got.columns == df.columns
    for r in got.collect():
        assert r.v == want[r.id]


def test_fill_keeps_an_all_missing_key(spark):
    df = spark.createDataFrame([("a", i, None, 1.0 if i == 3 else None) for i in range(6)], "k string, t int, x double, y double")
    rows = ordered.fill_within_key(df, "k", ["t"], ["x", "y"], rows_per_bucket=2).collect()
    assert all(r.x is None and r.y == 1.0 for r in rows)


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_scan_does_not_depend_on_partitions(hot, partitions):
    df, frame = hot
    got = ordered.scan(df.repartition(partitions), ["at", "id"], sums={"run": "w"}, rows_per_bucket=700)
    assert {r.id: (r["rank"], r.run) for r in got.collect()} == expected_scan(frame, False)


def test_timestamps_as_order(middle):
    sparse = middle.v_sparse.select("event_id", "ts")
    got = ordered.scan(sparse, ["ts", "event_id"], rows_per_bucket=800)
    want = sparse.toPandas().sort_values(["ts", "event_id"]).event_id.tolist()
    assert [r.event_id for r in got.orderBy("rank").collect()] == want
    last = got.filter("rank = 8000")
    assert last.first().event_id == want[7999]
    assert sparse.filter(ordered.at_or_below(["ts", "event_id"], last)).count() == 8000


@pytest.mark.parametrize("rows_per_bucket", [300, 10**6])
def test_quantiles(spark, rows_per_bucket):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1e6, 3000), np.zeros(3000), rng.exponential(1e-9, 501)])
    rows = [(float(v), None if i % 5 == 0 else int(i % 11)) for i, v in enumerate(x)] + [(float("nan"), None)]
    df = spark.createDataFrame(rows, "x double, k int")
    qs = [0.0, 0.25, 0.5, 0.61, 1.0]
    got = exact_quantiles(df, {"x": qs, "k": [0.5]}, rows_per_bucket)
    np.testing.assert_allclose(got["x"], np.quantile(x, qs), rtol=1e-12, atol=1e-300)
    assert got["k"] == [np.quantile([r[1] for r in rows if r[1] is not None], 0.5)]


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert exact_quantiles(df, {"x": [0.5]}) == {"x": [None]}


def test_fast_quantiles_are_close(middle):
    exact = {(r.column, r.q): r.value for r in quantile_table(middle.lineitem, {"l_quantity": [0.5]}).collect()}
    fast = {(r.column, r.q): r.value for r in quantile_table(middle.lineitem, {"l_quantity": [0.5]}, fast=True).collect()}
    assert abs(exact["l_quantity", 0.5] - fast["l_quantity", 0.5]) <= 1


def brute_windows(values, window, ahead):
    return {i: (values[i - window : i], values[i + ahead]) for i in range(window, len(values) - ahead)}


@pytest.mark.parametrize("index", [None, "t"])
@pytest.mark.parametrize("n, window, horizon, block", [(500, 60, 1, 64), (500, 7, 3, 5), (61, 60, 1, 64), (62, 60, 1, 64), (63, 60, 1, 8), (3, 60, 1, 64)])
def test_windows(spark, index, n, window, horizon, block):
    values = [float((i * 37) % 101) for i in range(n)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "t bigint, x double").repartition(3)
    got = ordered.sliding_windows(df, ["t"], ["x"], ["x"], window, horizon, index, block, rows_per_bucket=50)
    shown = {r.t: ([w.x for w in r.window], r.target.x) for r in got.collect()}
    assert shown == brute_windows(values, window, horizon + 1)


def test_windows_run_over_gaps_in_the_order_column(spark):
    values = [float(i % 13) for i in range(300)]
    df = spark.createDataFrame([(i * i, v) for i, v in enumerate(values)], "t bigint, x double")
    got = ordered.sliding_windows(df, ["t"], ["x"], ["x"], 5, 1, block=16, rows_per_bucket=40)
    assert {r.t: [w.x for w in r.window] for r in got.collect()} == {i * i: values[i - 5 : i] for i in range(5, 298)}


def test_splits_are_exact_and_disjoint(spark):
    df = spark.range(60_001).withColumnRenamed("id", "k")
    for share in (0.0, 0.3, 0.8, 1.0):
        sizes = dict(train_test(df, "k", share, seed=4).groupBy("split").count().collect())
        assert sizes.get("train", 0) == int(share * 60_001) and sum(sizes.values()) == 60_001
    once = exact_split(df, "k", {"a": 10, "b": 25_000, "c": 25_001}, "rest", seed=9)
    assert dict(once.groupBy("split").count().collect()) == {"a": 10, "b": 24_990, "c": 1, "rest": 35_000}
    again = exact_split(df.repartition(17), "k", {"a": 10, "b": 25_000, "c": 25_001}, "rest", seed=9)
    assert once.exceptAll(again).count() == 0


def test_hash_split_needs_no_count(spark):
    df = spark.range(20_000)
    sizes = dict(hash_split(df, "id", {"train": 0.7, "val": 0.15, "test": 0.15}, seed=2).groupBy("split").count().collect())
    assert abs(sizes["train"] - 14_000) < 300 and abs(sizes["val"] - 3000) < 200 and sum(sizes.values()) == 20_000


def test_sequential_split_and_batches(spark):
    df = spark.range(1003).select((F.col("id") * 3).alias("t"))
    split = sequential_split(df, ["t"])
    assert split.filter("split = 'test'").agg(F.count("t"), F.min("t")).first()[:] == (201, 802 * 3)
    sizes = [r[1] for r in batches(df, "t", 100, rows_per_bucket=60).groupBy("batch").count().orderBy("batch").collect()]
    assert sizes == [100] * 10 + [3]
    shuffled = batches(df, "t", 100, seed=1, rows_per_bucket=60).filter("batch = 0")
    assert shuffled.count() == 100 and shuffled.agg(F.max("t")).first()[0] > 1000
    assert sorted(r.t for r in shuffle_rows(df, "t", 3, 4).collect()) == list(range(0, 3009, 3))


def test_best_per_period_first_record_wins(spark):
    df = spark.createDataFrame([(1, 5.0, 2), (1, 5.0, 1), (1, 4.0, 0), (2, 1.0, 9)], "p int, v double, o int")
    got = ordered.best_per_period(df, F.col("p"), "v", [F.col("o")], [F.col("o")])
    assert {r.period: r.o for r in got.collect()} == {1: 1, 2: 9}


def test_no_unpartitioned_window(middle):
    df = middle.events.select("event_id", "ts", "value")
    plan = ordered.scan(df, ["ts", "event_id"], sums={"s": "value"}, rows_per_bucket=900)._jdf.queryExecution().executedPlan().toString()
    assert "windowspecdefinition(__bucket" in plan and "SinglePartition" not in plan


@pytest.mark.parametrize("accuracy, collected", [(10, 10**6), (10**9, 10**6), (50, 0)])
def test_exact_quantiles_around_the_sketch(spark, accuracy, collected):
    """A coarse sketch, one so close that ranks beside it are looked for again, and spans too full for the driver."""
    rng = np.random.default_rng(3)
    values = np.concatenate([np.round(rng.lognormal(0, 3, 3000), 3), np.full(1500, 7.5), [-1e300, 1e300, np.inf, -0.0]])
    ties = rng.integers(0, 3, len(values)).astype(float)
    rng.shuffle(values)
    rows = [(float(a), float(b), None, float(a) if i == 5 else float("nan")) for i, (a, b) in enumerate(zip(values, ties))]
    df = spark.createDataFrame(rows, "a double, b double, none double, one double").repartition(5)
    qs = [0.0, 0.0001, 0.25, 0.5, 0.5, 0.75, 0.99, 0.999]  # no rank next to infinity
    got = exact_quantiles(df, {"a": qs, "b": [*qs, 1.0], "none": [0.5], "one": [0.0, 0.3, 1.0]}, 700, accuracy, collected)
    assert got["a"] == pytest.approx(np.quantile(values, qs).tolist(), rel=1e-12) and got["b"] == pytest.approx(np.quantile(ties, [*qs, 1.0]).tolist())
    assert got["none"] == [None] and got["one"] == [values[5]] * 3
    assert exact_quantiles(df.limit(0), {"a": [0.5]}) == {"a": [None]}


@pytest.mark.parametrize("share", [0.0, 0.2, 0.5, 0.999, 1.0])
def test_sequential_split_over_ranges(hot, share):
    df = hot[0].select("at", "id")
    rows = sorted(map(tuple, df.collect()))
    cut = len(rows) - int(np.ceil(share * len(rows)))
    got = sequential_split(df, ["at", "id"], share, rows_per_bucket=97)
    assert sorted(map(tuple, got.collect())) == [(*r, "train" if i < cut else "test") for i, r in enumerate(rows)]
