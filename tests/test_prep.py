"""Hand cases for cleaning, encoding, inspection and sources."""

import math

import pytest
from pyspark.sql import functions as F

from millrace.operators import clean, encode, inspect
from millrace.sources import folders, tables


def column(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def test_to_numeric(spark):
    texts = ["12", " 12 ", "12_", "12d", "1,000", "", None, "-3.5e2", ".5", "5.", "NaN", "inf", "0x1F", "+7"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert column(df, clean.to_numeric("t")) == [12.0, 12.0, None, None, None, None, None, -350.0, 0.5, 5.0, None, None, None, 7.0]


def test_bounds_and_nan(spark):
    df = spark.createDataFrame([(0.0,), (99.0,), (100.0,), (-1.0,), (None,)], "x double")
    assert column(df, clean.within("x", 0, 99)) == [0.0, 99.0, None, None, None]
    assert column(df, clean.within("x", 0)) == [0.0, 99.0, 100.0, None, None]
    dirty = spark.createDataFrame([(float("nan"), 1), (None, 2), (3.0, 3)], "x double, k int")
    assert [r.x for r in clean.nan_to_null(dirty).orderBy("k").collect()] == [None, None, 3.0]


def test_medians_fill_each_table_with_its_own(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 4), (None, 10), (10.0, 3)], "a double, b int")
    got = clean.fill_with(df, clean.fit_medians(df, ["a", "b"]), ["a", "b"]).collect()
    assert [r.a for r in got] == [1.0, 2.0, 2.0, 10.0] and [r.b for r in got] == [4.0, 4.0, 10.0, 3.0]


def test_all_null_column_stays_null(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "a double, b double")
    assert [r.a for r in clean.fill_with(df, clean.fit_medians(df, ["a"]), ["a"]).collect()] == [None, None]


def test_fences_come_from_train(spark):
    train = spark.createDataFrame([(float(x),) for x in [1, 2, 3, 4, 100]], "x double")
    fences = clean.fit_fences(train, {"x": 2.5})
    assert fences.first()[:] == (2 - 1.5 * 2, 4 + 2.5 * 2)
    other = spark.createDataFrame([(9.0,), (9.1,), (-1.0,), (-1.1,)], "x double")
    assert [r.x for r in clean.apply_fences(other, fences, ["x"]).collect()] == [9.0, None, -1.0, None]


def test_recode_months_lists(spark):
    df = spark.createDataFrame([("Good", "22 Years and 1 Months", "A, B, and C"), ("?", "3 Years", "A"), (None, None, None), ("_", "7 Months", "B, B")], "m string, h string, l string")
    assert column(df, clean.recode("m", {"_": 4, "Good": 2})) == [2, None, None, 4]
    assert column(df, clean.months_of("h")) == [265, 36, 0, 7]
    lists = df.select(clean.missing_list_to_empty(encode.split_list("l")).alias("l"))
    assert [r.l for r in lists.collect()] == [["A", "B", "and C"], ["A"], [], ["B", "B"]]
    assert column(df, encode.split_list("l", strip_and=True))[0] == ["A", "B", "C"]
    hot = encode.multi_hot(lists, "l", encode.fit_tokens(lists.limit(2), "l"))
    assert [tuple(r)[1:] for r in hot.collect()] == [(1, 1, 1), (1, 0, 0), (0, 0, 0), (0, 1, 0)]
    pairs = encode.tokens_long(lists.withColumn("i", F.monotonically_increasing_id()), ["i"], "l")
    assert pairs.count() == 5


def test_split_separator_is_literal(spark):
    df = spark.createDataFrame([("a.b.c",)], "t string")
    assert column(df, encode.split_list("t", ".")) == [["a", "b", "c"]]


def test_one_hot_drops_the_first_and_skips_missing(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), (None, 3), ("new", 4)], "c string, k int")
    got = encode.one_hot(df, {"c": ["a", "b"]})
    assert got.columns == ["k", "c_b"] and [r.c_b for r in got.collect()] == [True, False, False, False]
    assert encode.one_hot(df, {"c": ["a", "b"]}, drop_first=False).columns == ["k", "c_a", "c_b"]
    assert encode.categories(df, ["c", "k"]) == {"c": ["a", "b", "new"], "k": ["1", "2", "3", "4"]}


def test_scalers(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "x double, k double")
    std = encode.fit_standard(df, ["x", "k"])
    z = encode.standardise(df, std, ["x", "k"]).collect()
    assert [r.x for r in z] == pytest.approx([-math.sqrt(1.5), 0, math.sqrt(1.5)]) and [r.k for r in z] == [0, 0, 0]
    back = encode.unstandardise(encode.standardise(df, std, ["x"]), std, {"x": "x"})
    assert [r.x for r in back.collect()] == pytest.approx([1, 2, 3])
    unit = encode.min_max(df, encode.fit_min_max(df, ["x", "k"]), ["x", "k"]).collect()
    assert [r.x for r in unit] == [0, 0.5, 1] and [r.k for r in unit] == [0, 0, 0]


def test_statistics_enter_as_constants_not_joins(spark):
    df = spark.range(10).select(F.col("id").cast("double").alias("x"))
    plan = encode.standardise(df, encode.fit_standard(df, ["x"]), ["x"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan


def test_varied_columns(spark):
    df = spark.createDataFrame([(1, 0, 5, None), (2, 1, 5, 1), (3, 1, 5, 1)], "a int, b int, c int, d int")
    assert encode.varied_columns(df, ["a", "b", "c", "d"]) == ["a"]
    assert encode.varied_columns(df, ["a", "b", "c", "d"], fast=True) == ["a"]


def test_weights(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,)], "y int")
    weights = {r.label: r.weight for r in encode.class_weights(df, "y").collect()}
    assert weights == pytest.approx({0: 0.25, 1: 0.75})


def test_align_and_profile(spark):
    left, right = spark.createDataFrame([(1, 2)], "a int, b int"), spark.createDataFrame([(3, 4)], "a int, c int")
    left, right = inspect.align(left, right)
    both = inspect.sort_columns(left.unionByName(right))
    assert both.columns == ["a", "b", "c"] and sorted(map(tuple, both.collect())) == [(1, 2, 0), (3, 0, 4)]
    df = spark.createDataFrame([(None, 1.0), (2, None), (None, 3.0)], "a int, b double")
    assert {r.column: (r.nulls, r.any_null) for r in inspect.null_profile(df).collect()} == {"a": (2, True), "b": (1, True)}
    assert inspect.drop_missing(df).count() == 0
    assert {r.column: r.type for r in inspect.types_table(df).collect()} == {"a": "int", "b": "double"}
    one = inspect.describe(spark.createDataFrame([(4.0,)], "x double")).first()
    assert (one.n, one["mean"], one["std"], one.median) == (1, 4.0, None, 4.0)


def test_csv_reads_dirty_columns_as_text(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    with open(path, "w") as f:
        f.write('id,amount,name\n1,12_,"a, b"\n2,,c\n')
    df = tables.scan_csv(spark, path, "id bigint, amount string, name string")
    assert [tuple(r) for r in df.collect()] == [(1, "12_", "a, b"), (2, None, "c")]


def test_file_names(spark):
    df = spark.createDataFrame([("d/great_pyrenees_12.jpg",), ("d/x_1.png",), ("plain.jpg",)], "path string")
    got = folders.route_by_filename(df, "path").collect()
    assert [(r.path, r.class_name) for r in got] == [("d/great_pyrenees_12.jpg", "great_pyrenees"), ("plain.jpg", "")]
