"""Batch steps against the expressions, and chains over images of several sizes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import vectors
from millrace.operators import image, pixels


@pytest.fixture(scope="module")
def shots(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(v) for v in rng.integers(0, 256, 8 * 6 * 3)]) for i in range(60)]
    return spark.createDataFrame(rows, "k bigint, px array<double>").repartition(3).persist()


def matrix(df):
    return np.array([r.px for r in df.orderBy("k").collect()])


PAIRS = {
    "normalise": (pixels.normalise([0.5, 0.4, 0.3], [0.2, 0.3, 0.4]), lambda p: image.normalise(p, [0.5, 0.4, 0.3], [0.2, 0.3, 0.4])),
    "gray": (pixels.grayscale(), image.grayscale),
    "nearest": (pixels.resize_nearest(4, 5), lambda p: image.resize_nearest(p, 8, 6, 4, 5, 3)),
    "centre": (pixels.centre_crop(4, 4), lambda p: image.centre_crop(p, 8, 6, 4, 4, 3)),
    "crop": (pixels.random_resized_crop(4, 4, (0.2, 1.0)), lambda p: image.random_resized_crop(p, "k", 8, 6, 4, 4, 3, scale=(0.2, 1.0))),
    "flip": (pixels.random_flip(), lambda p: image.random_flip(p, "k", 6, 3)),
    "bright": (pixels.brightness(0.3), lambda p: image.brightness(p, image.jitter_factor(0, "k", "brightness", 0.3))),
    "contrast": (pixels.contrast(0.3), lambda p: image.contrast(p, image.jitter_factor(0, "k", "contrast", 0.3), 3)),
    "blur": (pixels.blur(0.8), lambda p: image.blur(p, 8, 6, 3, 0.8)),
    "erase": (pixels.random_erase(0.7, (0.05, 0.3)), lambda p: image.random_erase(p, "k", 8, 6, 3, p=0.7, scale=(0.05, 0.3))),
    "min_max": (pixels.min_max(), vectors.min_max),
}


@pytest.mark.parametrize("name", sorted(PAIRS))
def test_step_equals_expression(shots, name):
    step, expression = PAIRS[name]
    got = matrix(pixels.run(shots, "px", "k", (8, 6, 3), [step]))
    np.testing.assert_allclose(got, matrix(shots.withColumn("px", expression(F.col("px")))), atol=1e-9)


def test_chains_by_split_over_several_sizes(spark):
    rng = np.random.default_rng(1)
    shapes = [(6, 9, 3), (10, 7, 3), (6, 9, 3), (12, 12, 3)]
    rows = [(i, "train" if i % 3 else "test", bytearray(rng.integers(0, 256, h * w * c, dtype=np.uint8).tobytes()), h, w, c) for i in range(40) for h, w, c in [shapes[i % 4]]]
    df = spark.createDataFrame(rows, "k bigint, part string, data binary, h int, w int, c int").repartition(4)
    tail = [pixels.normalise([0.5] * 3, [0.5] * 3)]
    chains = {
        "train": [pixels.random_resized_crop(4, 4, smooth=True), pixels.random_flip(), *pixels.colour_jitter(0.2, 0.2, 0.2, 0.1), pixels.random_affine(10), *tail],
        "test": [pixels.resize_shorter(5), pixels.centre_crop(4, 4), *tail],
    }
    got = pixels.run(df, "data", "k", ["h", "w", "c"], chains, split="part").orderBy("k").collect()
    assert all(len(r.data) == 48 and all(-1.000001 <= v <= 1.000001 for v in r.data) for r in got)
    again = pixels.run(df.repartition(2), "data", "k", ["h", "w", "c"], chains, split="part").orderBy("k").collect()
    assert [r.data for r in got] == [r.data for r in again]
    first = rows[0]
    shorter = pixels._bilinear(np.frombuffer(first[2], np.uint8).astype(float).reshape(1, 6, 9, 3), 5, 7)
    np.testing.assert_allclose(got[0].data, ((shorter[0, :, 2:6][:4] / 255 - 0.5) / 0.5).ravel(), atol=1e-9)
