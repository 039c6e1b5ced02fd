"""NULL and NaN in statistics, vectors and images."""

import numpy as np
import pytest

from millrace.operators import clean, encode, image, inspect, learn, pixels


@pytest.fixture(scope="module")
def gappy(spark):
    rows = [(1.0, 1.0, 1), (float("nan"), 2.0, 2), (3.0, float("nan"), None), (None, 2.0, 4)]
    return spark.createDataFrame(rows, "x double, y float, n int")


def test_profile_counts_nan(gappy):
    assert {r.column: (r.nulls, r.any_null) for r in inspect.null_profile(gappy).collect()} == {"x": (2, True), "y": (1, True), "n": (1, True)}


def test_describe_leaves_nan_out(gappy):
    got = {r.column: r for r in inspect.describe(gappy).collect()}
    assert (got["x"].n, got["x"]["mean"], got["x"]["min"], got["x"].median, got["x"]["max"]) == (2, 2.0, 1.0, 2.0, 3.0)
    assert got["y"]["max"] == 2.0 and got["n"].n == 3


def test_scales_of_what_is_known(gappy):
    stats = encode.fit_standard(gappy, ["x"])
    assert tuple(stats.first()) == (2.0, 1.0)
    assert [r.x for r in encode.standardise(gappy, stats, ["x"]).collect()][::2] == [-1.0, 1.0]
    assert tuple(encode.fit_min_max(gappy, ["x", "y"]).first()) == (1.0, 3.0, 1.0, 2.0)
    assert encode.varied_columns(gappy, ["x", "y", "n"]) == ["n"]
    assert clean.fit_medians(gappy, ["x", "y"]).first() == (2.0, 2.0)


def test_open_vocabulary_in_long_form(spark):
    df = spark.range(20_000).selectExpr("id", "concat('v', id) as a", "if(id % 2 = 0, null, 'odd') as b")
    assert encode.one_hot_long(df, ["id"], ["a", "b"]).count() == 30_000
    assert len(encode.categories(df, ["a"])["a"]) == 20_000


def test_missing_vectors(spark):
    layers = [(np.array([[1.0, 0.0], [0.0, 2.0]]), np.array([0.5, 0.0]))]
    df = spark.createDataFrame([(1, [1.0, 2.0], 1.0), (2, None, 2.0), (3, [0.0, 1.0], None)], "id int, v array<double>, y double")
    assert {r.id: r.logits for r in learn.score(df, "v", layers).collect()} == {1: [1.5, 4.0], 2: None, 3: [0.5, 2.0]}
    assert [r.logits for r in learn.score(df.filter("id = 2"), "v", layers).collect()] == [None]
    one = [(np.array([[1.0], [1.0]]), np.array([0.0]))]
    loss, grad = learn.gradient_step(df, "v", "y", one, "relu")
    assert loss == 4.0 and grad.tolist() == [4.0, 8.0, 4.0]


def test_missing_and_broken_images(spark):
    df = spark.createDataFrame([(1, [3.0, 6.0, 9.0]), (2, None)], "id int, px array<double>")
    got = pixels.run(df, "px", "id", (1, 1, 3), [pixels.Step(lambda a, u: a + 1)])
    assert {r.id: r.px for r in got.collect()} == {1: [4.0, 7.0, 10.0], 2: None}
    assert [r.g for r in df.select(image.grayscale("px").alias("g")).collect()][1] is None
    with pytest.raises(Exception, match="three values"):
        spark.createDataFrame([([1.0, 2.0],)], "px array<double>").select(image.grayscale("px")).collect()
