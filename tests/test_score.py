"""Evaluation, images and learning: properties and brute force."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import vectors
from millrace.operators import evaluate, image, inspect, learn, pixels
from millrace.operators.lookup import one_row
from millrace.plans import flows
from millrace.sources import folders, tables


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(4)
    rows = [(g, int(rng.random() < 0.4), round(rng.random(), 2)) for g in ("a", "a", "a", "b") for _ in range(400)]
    return spark.createDataFrame(rows, "g string, y int, s double"), rows


def pair_auc(rows):
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


def brute_ap(rows):
    total, seen, ap, last = sum(y for y, _ in rows), 0, 0.0, 0.0
    for t in sorted({s for _, s in rows}, reverse=True):
        hit = [y for y, s in rows if s >= t]
        ap += (sum(hit) / total - last) * sum(hit) / len(hit)
        last = sum(hit) / total
    return ap


@pytest.mark.parametrize("rows_per_bucket", [11, 10**6])
def test_areas(scored, rows_per_bucket):
    df, rows = scored
    counts = evaluate.score_counts(df, "y", "s", ["g"])
    got = {r.g: (r.auc, r.ap) for r in evaluate.areas(counts, ["g"], rows_per_bucket).collect()}
    for g in "ab":
        mine = [(y, s) for k, y, s in rows if k == g]
        assert got[g] == pytest.approx((pair_auc(mine), brute_ap(mine)))
    both = evaluate.areas(evaluate.pooled(counts), rows_per_bucket=rows_per_bucket).first()
    assert both.auc == pytest.approx(pair_auc([(y, s) for _, y, s in rows]))


def test_curves_end_points_and_threshold(scored):
    df, rows = scored
    counts = evaluate.score_counts(df, "y", "s")
    roc = evaluate.roc_curve(counts, rows_per_bucket=10)
    points = [tuple(r) for r in roc.orderBy(F.desc("threshold")).collect()]
    assert points[0] == (float("inf"), 0.0, 0.0) and points[-1][1:] == (1.0, 1.0)
    best = evaluate.best_threshold(roc)
    j = max(t - f for _, f, t in points)
    cut = best.first().threshold
    assert cut == next(c for c, f, t in points if t - f == j)
    above = evaluate.relabel(df, "s", one_row(best)["threshold"])
    assert above.filter("pred = 1").count() == sum(s > cut for _, _, s in rows)
    pr = [tuple(r) for r in evaluate.pr_curve(counts).collect()]
    assert (None, 1.0, 0.0) in pr and len(pr) == len(points)


def test_one_class_only(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.2)], "y int, s double")
    got = evaluate.areas(evaluate.score_counts(df, "y", "s")).first()
    assert got.auc is None and got.ap == 1.0


def test_binned_scores_bound_the_counts(scored):
    df, _ = scored
    counts = evaluate.score_counts(df, "y", "s", bins=10)
    assert counts.count() <= 11 and abs(evaluate.areas(counts).first().auc - evaluate.areas(evaluate.score_counts(df, "y", "s")).first().auc) < 0.05


def test_report_with_unpredicted_class(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "y int, p int")
    cells = evaluate.confusion(df, "y", "p")
    assert cells.count() == 9 and cells.agg(F.sum("n")).first()[0] == 4
    got = {r["name"]: (r.precision, r.recall, r.f1, r.support) for r in evaluate.report(cells).collect()}
    assert got["2"] == (0.0, 0.0, 0.0, 1) and got["0"] == pytest.approx((1.0, 0.5, 2 / 3, 2))
    assert got["accuracy"] == pytest.approx((0.5, 0.5, 0.5, 4))
    assert got["macro avg"] == pytest.approx((4 / 9, 0.5, (2 / 3 + 0.5) / 3, 4))
    assert got["weighted avg"] == pytest.approx(((2 + 1 / 3) / 4, 0.5, (4 / 3 + 0.5) / 4, 4))


def test_vector_functions(spark):
    df = spark.createDataFrame([([1000.0, 1001.0, 1001.0],), ([3.0, 3.0, 3.0],)], "v array<double>")
    e = np.exp([-1, 0, 0])
    assert df.select(vectors.softmax("v")).first()[0] == pytest.approx(list(e / e.sum()))
    assert df.select(vectors.log_sum_exp("v")).first()[0] == pytest.approx(1001 + np.log(e.sum()))
    assert [r[0] for r in df.select(vectors.argmax("v")).collect()] == [1, 0]
    assert [r[0] for r in df.select(vectors.min_max("v")).collect()] == [[0, 1, 1], [0, 0, 0]]
    x = df.select(F.transform("v", lambda x: x - 3).alias("v")).limit(2)
    assert x.select(vectors.relu(F.transform("v", lambda a: -a))).first()[0] == [0, 0, 0]


def images(spark, n, h, w, c, seed=0):
    rng = np.random.default_rng(seed)
    px = rng.integers(0, 256, (n, h * w * c)).astype(float)
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(px)], "k bigint, px array<double>"), px


def shown(df, column="px"):
    return np.array([r[0] for r in df.orderBy("k").select(column).collect()])


def test_geometry(spark):
    df, px = images(spark, 5, 4, 6, 3)
    cube = px.reshape(5, 4, 6, 3)
    np.testing.assert_array_equal(shown(df.withColumn("px", image.flip("px", 6, 3))), cube[:, :, ::-1].reshape(5, -1))
    cut = image.centre_crop("px", 4, 6, 2, 4, 3)
    np.testing.assert_array_equal(shown(df.withColumn("px", cut)), cube[:, 1:3, 1:5].reshape(5, -1))
    near = image.resize_nearest("px", 4, 6, 2, 3, 3)
    np.testing.assert_array_equal(shown(df.withColumn("px", near)), cube[:, 1::2, 1::2].reshape(5, -1))
    same = pixels.run(df, "px", "k", (4, 6, 3), [pixels.resize(4, 6)])
    np.testing.assert_allclose(shown(same), px)


def test_affine(spark):
    df, px = images(spark, 4, 5, 5, 1)
    cube = px.reshape(4, 5, 5)
    np.testing.assert_array_equal(shown(pixels.run(df, "px", "k", (5, 5, 1), [pixels.affine()])), px)
    turned = shown(pixels.run(df, "px", "k", (5, 5, 1), [pixels.affine(90.0)])).reshape(4, 5, 5)
    np.testing.assert_array_equal(turned, np.rot90(cube, k=-1, axes=(1, 2)))
    moved = shown(pixels.run(df, "px", "k", (5, 5, 1), [pixels.affine(translate=(2, 0), fill=-1.0)])).reshape(4, 5, 5)
    np.testing.assert_array_equal(moved[:, :, 2:], cube[:, :, :3])
    assert (moved[:, :, :2] == -1).all()


def test_random_steps_repeat(spark):
    df, px = images(spark, 200, 6, 6, 1)
    steps = [pixels.random_affine(20, (0.2, 0.2), (0.8, 1.2), 5)]
    one = shown(pixels.run(df, "px", "k", (6, 6, 1), steps, seed=3))
    two = shown(pixels.run(df.repartition(7), "px", "k", (6, 6, 1), steps, seed=3))
    np.testing.assert_array_equal(one, two)
    assert (one != shown(pixels.run(df, "px", "k", (6, 6, 1), steps, seed=4))).any()
    flipped = (shown(df.withColumn("px", image.random_flip("px", "k", 6))) != px).any(axis=1).mean()
    assert 0.4 < flipped < 0.6
    erased = shown(df.withColumn("px", image.random_erase("px", "k", 6, 6, p=1.0, scale=(0.1, 0.3), value=-1.0)))
    share = (erased == -1).mean(axis=1)
    assert share.max() <= 0.6 and (share > 0).mean() > 0.9


def test_hue(spark):
    rng = np.random.default_rng(1)
    rgb = rng.integers(0, 256, (3, 10, 3)).astype(float)
    np.testing.assert_allclose(pixels.turn_hue(rgb, np.zeros(3)), rgb, atol=1e-9)
    np.testing.assert_allclose(pixels.turn_hue(rgb, np.full(3, 1 / 3)), rgb[:, :, [2, 0, 1]], atol=1e-9)
    df, px = images(spark, 3, 2, 2, 3)
    np.testing.assert_allclose(shown(pixels.run(df, "px", "k", (2, 2, 3), [pixels.saturation(0.0), pixels.hue(0.0)])), px, atol=1e-9)


def test_blur_of_a_constant(spark):
    df = spark.createDataFrame([(0, [7.0] * 12)], "k bigint, px array<double>")
    np.testing.assert_allclose(shown(df.withColumn("px", image.blur("px", 3, 4))), [[7.0] * 12])


def png(path, cube):
    h, w, _ = cube.shape
    raw = b"".join(b"\x00" + row.astype(np.uint8).tobytes() for row in cube)

    def part(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))


def test_labeled_folder(spark, tmp_path):
    rng = np.random.default_rng(0)
    made = {}
    for name, shape in (("zebra", (2, 4)), ("ant", (3, 3)), ("mole", (3, 3))):
        (tmp_path / name).mkdir()
        for i in range(2):
            cube = rng.integers(0, 256, (*shape, 3))
            png(tmp_path / name / f"{i}.png", cube)
            made[f"{name}/{i}.png"] = cube
    (tmp_path / "ant" / "broken.png").write_bytes(b"no image")
    got = folders.scan_labeled_folder(spark, str(tmp_path)).collect()
    assert {r.class_name: r.label for r in got} == {"ant": 0, "mole": 1, "zebra": 2}
    assert len(got) == 6
    for r in got:
        cube = made["/".join(r.path.split("/")[-2:])]
        assert (r.height, r.width, r.channels) == cube.shape
        assert bytes(r.data) == cube[:, :, ::-1].astype(np.uint8).tobytes()


def test_folder_flow(spark, tmp_path):
    rng = np.random.default_rng(3)
    for name, level in (("bright", 200), ("dark", 60)):
        (tmp_path / name).mkdir()
        for i in range(30):
            png(tmp_path / name / f"{i}.png", np.clip(rng.normal(level, 20, (6, 8, 3)), 0, 255))
        png(tmp_path / name / "odd.png", np.zeros((5, 5, 3)))
    tail = [pixels.grayscale(), pixels.resize(2, 2), pixels.normalise([0.5], [0.5])]
    images = flows.prepared_folder(
        spark, str(tmp_path), {"train": [pixels.random_flip(), *tail], "test": tail}, {"train": 0.5, "test": 0.5}, keep=inspect.exact_size("width", "height", 8, 6)
    )
    assert images.count() == 60 and {len(r.data) for r in images.collect()} == {4}
    layers = [(np.array([[1.0, -1.0]] * 4), np.zeros(2))]  # bright against dark
    got = flows.folder_reports(images, layers)
    assert {r["name"]: r.recall for r in got["report"].collect()}["accuracy"] == 1.0
    assert {r.auc for r in got["areas"].collect()} == {1.0}


def test_gradient_equals_finite_difference():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(20, 3)), rng.normal(size=20)
    for kind in ("elu", "relu"):
        layers = learn.starting_weights([3, 5, 4, 1], seed=1)
        loss, grads = learn.squared_error_gradient(x, y, layers, kind)
        flat, slope = learn.flatten(layers), learn.flatten(grads)
        for i in range(0, len(flat), 5):
            step = flat.copy()
            step[i] += 1e-6
            up, _ = learn.squared_error_gradient(x, y, learn.unflatten(step, layers), kind)
            assert (up - loss) / 1e-6 == pytest.approx(slope[i], rel=1e-3, abs=1e-3)


@pytest.fixture(scope="module")
def generated(spark):
    df = tables.regression_data(spark.range(3000), "id", [2.0, -1.0, 0.5], noise=0.1)
    return df.select("id", F.array("feature_1", "feature_2", "feature_3").alias("x"), "target").persist()


def test_generated_data_recovers_weights(generated):
    rows = generated.collect()
    x, y = np.array([r.x for r in rows]), np.array([r.target for r in rows])
    np.testing.assert_allclose(np.linalg.lstsq(x, y, rcond=None)[0], [2.0, -1.0, 0.5], atol=0.02)
    assert abs(x.mean()) < 0.05 and abs(x.std() - 1) < 0.05


def test_network_training(spark, generated, tmp_path):
    layers, losses = learn.fit_mlp(generated, "x", "target", hidden=(8,), steps=12, rate=0.05)
    assert losses[-1] < losses[0] / 2
    one, g1 = learn.gradient_step(generated.coalesce(1), "x", "target", layers, "elu")
    many, g2 = learn.gradient_step(generated.repartition(9), "x", "target", layers, "elu")
    assert one == pytest.approx(many) and g1 == pytest.approx(g2)
    tables.save_weights(generated, layers, str(tmp_path / "w"))
    again = tables.load_weights(spark, str(tmp_path / "w"))
    a = learn.score(generated, "x", layers, "elu", "out").collect()
    b = {r.id: r.out for r in learn.score(generated, "x", again, "elu", "out").collect()}
    assert all(r.out == b[r.id] for r in a)
    _, more = learn.fit_mlp(generated, "x", "target", steps=2, start=again)
    assert more[0] < losses[0] / 2


def descent_by_hand(x, y, shapes, flat, steps, rate):
    """Losses and weights of the same descent; gradients by central differences."""
    def loss(flat):
        h, at = x, 0
        for k, (i, o) in enumerate(shapes):
            z = h @ flat[at : at + i * o].reshape(i, o) + flat[at + i * o : at + i * o + o]
            h, at = np.where(z > 0, z, np.exp(np.minimum(z, 0)) - 1) if k < len(shapes) - 1 else z, at + i * o + o
        return ((h[:, 0] - y) ** 2).mean()

    a, b, losses = np.zeros_like(flat), np.zeros_like(flat), []
    for t in range(1, steps + 1):
        losses.append(loss(flat))
        g = np.array([(loss(flat + e) - loss(flat - e)) / 2e-5 for e in np.eye(len(flat)) * 1e-5])
        a, b = 0.9 * a + 0.1 * g, 0.999 * b + 0.001 * g * g
        flat = flat - rate * (a / (1 - 0.9**t) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8) + 5e-4 * flat)
    return losses, flat


def test_hidden_layer_queries_by_hand(spark):
    from millrace.plans import queries_score as q
    from millrace.plans.registry import QUERIES, Inputs

    folder = "/root/testdata/sf0.001"
    inputs = Inputs(spark, folder)
    one, two = ([np.array(c) for c in zip(*q.generated(inputs, *a).collect(), strict=True)] for a in ((), (43, q.SECOND)))
    width = one[0].shape[1]
    for sizes, name in (((width, 16, 8, 1), "m3_hidden_layers"), ((width, 8, 1), "m7_hidden_second_stage")):
        rng, shapes = np.random.default_rng(0), list(zip(sizes, sizes[1:], strict=False))
        flat = np.concatenate([p for i, o in shapes for p in (rng.normal(0, np.sqrt(2 / i), (i, o)).ravel(), np.zeros(o))])
        want, flat = descent_by_hand(*one, shapes, flat, 12 if len(sizes) == 4 else 8, 0.03)
        want += descent_by_hand(*two, shapes, flat, 6, 0.01)[0] if len(sizes) == 3 else []
        np.testing.assert_allclose([r.loss for r in QUERIES[name](spark, folder).collect()], want, rtol=1e-3)


def test_forecast_beats_the_mean(spark):
    rows = [(i, float(np.sin(i / 9.0)), float(np.sin(i / 9.0) + 0.1)) for i in range(900)]
    df = spark.createDataFrame(rows, "t bigint, open double, close double")
    first = learn.forecast(df, ["t"], ["open", "close"], ["open", "close"], window=20, horizon=1, block=128).collect()
    again = learn.forecast(df.repartition(5), ["t"], ["open", "close"], ["open", "close"], window=20, horizon=1, block=128).collect()
    assert len(first) == 4 and all(r.rmse < r.mean_rmse / 5 for r in first)
    assert {(r.target, r.split): pytest.approx(r.rmse, abs=1e-6) for r in first} == {(r.target, r.split): r.rmse for r in again}


def test_shares_follow_the_rows(spark):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = spark.range(5_000).select("id", (F.col("id") % 7).alias("v")).unionByName(spark.createDataFrame([(None, 1), (1, 1), (1, 1)], "id long, v long"))
    shared = learn.spread(df, rows_per_share=200)
    sizes = shared.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(sizes) == 26 > least and max(sizes) <= 250
    for rows in (shared, learn.spread(df)):
        assert sorted(map(str, rows.collect())) == sorted(map(str, df.collect()))


def test_saved_pipeline(spark, generated, tmp_path):
    wide = generated.select("target", *[F.col("x")[i].alias(f"x{i}") for i in range(3)])
    model = learn.fit_boosted_trees(wide, ["x0", "x1", "x2"], "target", rounds=3, depth=3)
    tables.save_model(model, str(tmp_path / "m"))
    again = tables.load_model(str(tmp_path / "m"))
    a, b = (m.transform(wide).agg(F.sum("prediction")).first()[0] for m in (model, again))
    assert a == pytest.approx(b)
    fit = evaluate.regression_metrics(model.transform(wide), "target", "prediction").first()
    assert fit.r2 > 0.5 and fit.pearson > 0.7


def test_classifier_continues_from_weights(spark):
    rng = np.random.default_rng(0)
    rows = [([float(v) for v in rng.normal(3 * k, 1, 2)], k) for k in (0, 1, 2) for _ in range(80)]
    df = spark.createDataFrame(rows, "v array<double>, y int")
    model = learn.fit_classifier(df, "v", "y", [6], 3, steps=60)
    more = learn.fit_classifier(df, "v", "y", [6], 3, steps=5, start=model.weights)
    seen = df.select(learn.array_to_vector("v").alias("features"), F.col("y").cast("double").alias("y"))
    assert evaluate.accuracy(more.transform(seen), "y", "prediction").first()[0] > 0.9
