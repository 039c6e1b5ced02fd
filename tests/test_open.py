"""Open vocabularies, sketches, binned areas, and image folders with broken files."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import encode, evaluate, inspect, quantiles
from millrace.operators.lookup import replace_cells, replace_values
from millrace.session import stage
from millrace.sources import folders, tables


def test_open_dictionary_and_places(spark):
    rows = [(1, "b", 7), (1, "b", 7), (2, None, 7), (3, "a", None), (None, None, None), (4, "ü", -1)]
    df = spark.createDataFrame(rows, "k int, c string, n int").repartition(3)
    known = encode.fit_dictionary(df, ["c", "n"])
    want = sorted({("c", r[1]) for r in rows if r[1]} | {("n", str(r[2])) for r in rows if r[2] is not None})
    assert [(r["column"], r["value"]) for r in known.orderBy("index").collect()] == want
    assert sorted(r["index"] for r in known.collect()) == list(range(len(want)))
    at = {x: i for i, x in enumerate(want)}
    expected = sorted(str((k, sorted(at[x] for x in (("c", c), ("n", str(n))) if x in at))) for k, c, n in rows)
    assert sorted(str((r.k, r.indices)) for r in encode.encode_open(df, ["c", "n"], known).collect()) == expected
    other = spark.createDataFrame([(9, "new", 7)], "k int, c string, n int")
    assert encode.encode_open(other, ["c", "n"], known).head().indices == [at["n", "7"]]
    none = df.filter("k = 77")
    assert encode.fit_dictionary(none, ["c"]).count() == 0 and encode.encode_open(none, ["c"], known).count() == 0


def test_a_hundred_thousand_levels(spark):
    df = spark.range(100_000).select((F.col("id") * 7919 % 100_000).alias("a"))
    known = encode.fit_dictionary(df, ["a"])
    assert known.agg(F.count("*"), F.min("index"), F.max("index"), F.countDistinct("index")).head() == (100_000, 0, 99_999, 100_000)
    out = encode.encode_open(df, ["a"], known)
    assert out.filter(F.size("indices") != 1).count() == 0 and out.select(F.explode("indices")).distinct().count() == 100_000


def test_tasks_follow_the_cells(spark):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    value = F.when(F.col("id") % 2 == 0, "often").when(F.col("id") % 5 == 0, "new").when(F.col("id") % 7 != 0, F.concat(F.lit("v"), (F.col("id") % 900).cast("string")))
    df = spark.range(6_000).select(F.col("id").alias("k"), value.alias("c"), F.when(F.col("id") % 3 == 0, F.col("id") % 10).alias("n"))
    df = df.unionByName(df.filter("k < 4"))
    known = encode.fit_dictionary(df.filter("c is null or c != 'new'"), ["c", "n"])
    one = encode.encode_open(df, ["c", "n"], known)
    for most in (300, 1_000_000):
        assert sorted(map(str, encode.encode_open(df, ["c", "n"], known, cells_per_task=most).collect())) == sorted(map(str, one.collect()))
    many = encode.encode_open(df, ["c", "n"], known, cells_per_task=300)
    assert many.rdd.getNumPartitions() == -(-6_004 * 2 // 300) > least
    again = encode.fit_dictionary(df.filter("c is null or c != 'new'"), ["c", "n"], cells_per_task=300)
    assert sorted(map(str, again.collect())) == sorted(map(str, known.collect()))
    often = {(r["column"], r["value"]) for r in encode._often(df, ["c", "n"], 0.1).collect()}
    assert {("c", "often"), ("c", "new")} <= often and len(often) <= 30


def test_quantile_sketches_add_up(spark):
    rng = random.Random(2)
    values = [rng.expovariate(1) for _ in range(30_000)] + [5.0] * 10_000  # a value with a quarter of all rows
    rows = [(i % 50, x) for i, x in enumerate(values)] + [(0, None), (1, float("nan"))]
    df = spark.createDataFrame(rows, "day int, x double").repartition(7)
    kept = quantiles.quantile_sketches(df, ["x"], ["day"])
    found = stage(quantiles.sketched_quantiles(kept, [0.0, 0.1, 0.5, 0.9, 1.0]), "found")  # sketches draw at random
    assert kept.count() == 50 and {(r.n, r.parts) for r in found.collect()} == {(40_000, 50)}
    ordered = np.sort(values)
    errors = {r.q: r.error for r in quantiles.rank_errors(df, found).collect()}
    for r in found.collect():
        low, high = np.searchsorted(ordered, r.value, "left") / 40_000, np.searchsorted(ordered, r.value, "right") / 40_000
        assert errors[r.q] == pytest.approx(max(low - r.q, r.q - high, 0)) and errors[r.q] < 0.01
    days = quantiles.sketched_quantiles(kept, [0.5], ["day"])
    assert days.count() == 50
    assert quantiles.sketched_quantiles(quantiles.quantile_sketches(df.filter("day = 99"), ["x"]), [0.5]).count() == 0


def test_distinct_sketches_add_up(spark):
    rows = [(i % 20, i % 7001, f"t{i % 3}") for i in range(40_000)] + [(0, None, None)]
    df = spark.createDataFrame(rows, "day int, a int, b string")
    found = {r["column"]: r for r in inspect.sketched_distinct(inspect.distinct_sketches(df, ["a", "b"], ["day"])).collect()}
    assert abs(found["a"]["distinct"] - 7001) < 0.04 * 7001 and found["b"]["distinct"] == 3
    assert all(r["n"] == 40_000 and r["parts"] == 20 for r in found.values())


@pytest.mark.parametrize("bins", [1, 7, 50])
def test_area_bounds_hold_the_exact_area(spark, bins):
    rng = random.Random(bins)
    rows = [(k, rng.random() < 0.3, round(rng.random() ** (1 + k), 3)) for k in range(3) for _ in range(400)] + [(9, True, 0.5)]
    df = spark.createDataFrame([(k, int(y), s) for k, y, s in rows], "class int, y int, score double")
    parts = [evaluate.score_counts(df.filter(F.col("score") * 1000 % 2 == i), "y", "score", ["class"], bins=bins) for i in (0, 1)]
    whole = df.filter(F.col("score") * 1000 % 2 == 0).unionByName(df.filter(F.col("score") * 1000 % 2 == 1))
    bounds = {r["class"]: r for r in evaluate.area_bounds(evaluate.merged_counts(*parts, key=["class"]), ["class"], rows_per_bucket=5).collect()}
    exact = {r["class"]: r.auc for r in evaluate.areas(evaluate.score_counts(whole, "y", "score", ["class"]), ["class"]).collect()}
    assert exact.keys() == bounds.keys()
    for k, area in exact.items():
        low, high = bounds[k].auc_low, bounds[k].auc_high
        if k == 9 or area is None:
            assert low is None and high is None
            continue
        mine = [(int(s * bins), y) for c, y, s in ((r["class"], r.y, r.score) for r in whole.collect()) if c == k]
        pos, neg = [b for b, y in mine if y], [b for b, y in mine if not y]
        assert low == pytest.approx(sum(p > n for p in pos for n in neg) / len(pos) / len(neg))
        assert high == pytest.approx(sum(p >= n for p in pos for n in neg) / len(pos) / len(neg))
        assert low - 1e-12 <= area <= high + 1e-12


def test_written_images_come_back(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(f"deep/{'x' * (i + 1)}/cat/{i}.png", 2 + i, 3, c, rng.integers(0, 256, (2 + i) * 3 * c, dtype=np.uint8).tobytes()) for i, c in enumerate((1, 3, 4))]
    rows += [("dog/short.png", 2, 2, 1, b"abc"), ("dog/null.png", None, 2, 1, b"ab"), ("dog/ok.png", 1, 2, 1, b"\x00\xff")]
    df = spark.createDataFrame(rows, "file string, height int, width int, channels int, data binary")
    files = folders.encode_png(df)
    bad = files.withColumn("content", F.coalesce("content", F.lit(b"no image")))
    root = f"file://{tmp_path}/images"
    assert folders.write_files(files.select("file", "content"), root).count() == 4  # without a size there is no file
    assert folders.write_files(bad, root).count() == 6  # written again, and the broken ones
    got = {r.path.split("/images/")[1]: r for r in folders.scan_with_broken(spark, root).collect()}
    assert set(got) == {r[0] for r in rows} and sum(r.broken for r in got.values()) == 2
    for name, h, w, c, data in (*rows[:3], rows[5]):
        r = got[name]
        assert (r.height, r.width, r.channels, bytes(r.data)) == (h, w, c, data)
        assert (r.class_name, r.label) == (("cat", 0) if "cat" in name else ("dog", 1))
    assert got["dog/short.png"].data is None and got["dog/short.png"].height is None
    assert folders.scan_labeled_folder(spark, root).count() == 4


@pytest.mark.parametrize("multi_line", [False, True])
def test_rejected_lines(spark, tmp_path, multi_line):
    (tmp_path / "a.csv").write_text('k,x,t\n1,2.5,one\n2,bad,two\n3,1\n4,1,a,b\n\n5,,"say ""hi"""\n')
    (tmp_path / "b.csv").write_text("k,x,t\nx,1,late\n6,1e3,\n")
    good, rejected = tables.split_csv(spark, str(tmp_path), "k int, x double, t string", multi_line=multi_line)
    assert sorted(map(tuple, good.collect())) == [(1, 2.5, "one"), (5, None, 'say "hi"'), (6, 1000.0, None)]
    assert sorted((r.file.rpartition("/")[2], r.block, r.line) for r in rejected.collect()) == [("a.csv", 0, "2,bad,two"), ("a.csv", 0, "3,1"), ("a.csv", 0, "4,1,a,b"), ("b.csv", 0, "x,1,late")]


def test_cells_are_replaced_in_one_join(spark):
    rows = [(1, "a", "b", None), (1, "a", "b", None), (2, "c", None, "a"), (3, "x", "y", "z"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "k int, p string, q string, r string").repartition(2)
    words = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", "old", 1), ("c", "new", 2), ("z", None, 1), (None, "n", 1)], "f string, t string, o int")
    want = sorted(str(tuple(r)) for r in replace_values(df, words, "f", "t", order="o").collect())
    got = replace_cells(df, words, "f", "t", order="o")
    assert got.columns == df.columns and sorted(str(tuple(r)) for r in got.collect()) == want
    assert "('new'" in str(want) or "'new'" in str(want)
    assert replace_cells(df, words, "f", "t", ["q"]).filter("p = 'b'").count() == 0
    assert replace_cells(df.filter("k = 9"), words, "f", "t").count() == 0
