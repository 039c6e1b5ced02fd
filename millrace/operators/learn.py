"""Fitting and scoring with the data left on the executors."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.scalar import known
from millrace.functions.vectors import argmax, softmax
from millrace.operators.evaluate import regression_metrics
from millrace.operators.ordered import scan, sliding_windows
from millrace.session import stage

Layers = list[tuple[np.ndarray, np.ndarray]]  # per layer: weights (inputs x outputs), bias
ROWS_PER_SHARE = 250_000


def spread(df: DataFrame, rows_per_share: int = ROWS_PER_SHARE) -> DataFrame:
    """Even shares for a repeated pass over rows that may come in few or uneven splits.

    The rows are stored and their number decides how many shares there are, so what a task holds and reads again in
    each pass stays near ``rows_per_share`` however large the table is."""
    rows = stage(df, "spread-rows")
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = math.ceil(rows.count() / rows_per_share)  # the count comes from the files' footers
    return rows.repartition(shares) if shares > least else rows.hint("rebalance")


def _activate(z: np.ndarray, kind: str) -> np.ndarray:
    if kind == "relu":
        return np.maximum(z, 0)
    return np.where(z > 0, z, np.expm1(np.minimum(z, 0))) if kind == "elu" else z


def _slope(z: np.ndarray, kind: str) -> np.ndarray:
    if kind == "relu":
        return (z > 0).astype(float)
    return np.where(z > 0, 1.0, np.exp(np.minimum(z, 0))) if kind == "elu" else np.ones_like(z)


def forward(x: np.ndarray, layers: Layers, activation: str) -> np.ndarray:
    for i, (w, b) in enumerate(layers):
        x = x @ w + b
        x = _activate(x, activation) if i < len(layers) - 1 else x
    return x


def squared_error_gradient(x: np.ndarray, y: np.ndarray, layers: Layers, activation: str) -> tuple[float, Layers]:
    """Sum of squared errors over the rows and its gradient, not yet divided by the row count."""
    zs, hs = [], [x]
    for i, (w, b) in enumerate(layers):
        zs.append(hs[-1] @ w + b)
        hs.append(_activate(zs[-1], activation) if i < len(layers) - 1 else zs[-1])
    error = hs[-1][:, 0] - y
    back, grads = 2 * error[:, None], []
    for i in reversed(range(len(layers))):
        if i < len(layers) - 1:
            back = back * _slope(zs[i], activation)
        grads.append((hs[i].T @ back, back.sum(axis=0)))
        back = back @ layers[i][0].T
    return float(error @ error), grads[::-1]


def flatten(layers: Layers) -> np.ndarray:
    return np.concatenate([part.ravel() for layer in layers for part in layer])


def unflatten(flat: np.ndarray, like: Layers) -> Layers:
    out, at = [], 0
    for w, b in like:
        out.append((flat[at : at + w.size].reshape(w.shape), flat[at + w.size : at + w.size + b.size]))
        at += w.size + b.size
    return out


def starting_weights(sizes: Sequence[int], seed: int = 0) -> Layers:
    rng = np.random.default_rng(seed)
    return [(rng.normal(0, np.sqrt(2 / i), (i, o)), np.zeros(o)) for i, o in zip(sizes, sizes[1:])]


def _whole(batch: pa.RecordBatch, *columns: str) -> pa.RecordBatch:
    """The rows in which no vector or number asked for is missing."""
    valid = np.ones(batch.num_rows, dtype=bool)
    for c in columns:
        valid &= batch.column(c).is_valid().to_numpy(zero_copy_only=False)
    return batch if valid.all() else batch.filter(pa.array(valid))


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)


def gradient_step(data: DataFrame, features: str, target: str, layers: Layers, activation: str) -> tuple[float, np.ndarray]:
    """Mean squared error and its gradient over all rows.

    Rows with a missing vector or target are left out. Each task sums the gradient of its own rows; the sums are added per parameter in a
    shuffle, so the driver gets one value per parameter, never one per task.
    """
    shared = data.sparkSession.sparkContext.broadcast((layers, activation))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layers, activation = shared.value
        total = None
        for b in batches:
            b = _whole(b, features, target)
            if b.num_rows:
                loss, grads = squared_error_gradient(_matrix(b, features), b.column(target).to_numpy(), layers, activation)
                part = np.concatenate([[b.num_rows, loss], flatten(grads)])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["i", "v"])

    sums = data.select(features, target).mapInArrow(work, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    flat = np.array([v for _, v in sorted(map(tuple, sums.collect()))])
    shared.unpersist()
    return float(flat[1] / flat[0]), flat[2:] / flat[0]


def fit_mlp(
    df: DataFrame, features: str, target: str, hidden: Sequence[int] = (32, 32, 16), activation: str = "elu", steps: int = 50,
    rate: float = 0.02, decay: float = 5e-4, seed: int = 0, start: Layers | None = None,
) -> tuple[Layers, list[float]]:
    """Full-batch AdamW on a small regression network; returns weights and loss per step.

    ``start`` continues from earlier weights (second stage on other data).
    """
    data = spread(df.select(features, F.col(target).cast("double").alias(target))).persist()
    width = data.select(F.max(F.size(features))).first()[0]
    layers = start or starting_weights([width, *hidden, 1], seed)
    flat, first, second, losses = flatten(layers), 0.0, 0.0, []
    for t in range(1, steps + 1):
        loss, grad = gradient_step(data, features, target, unflatten(flat, layers), activation)
        losses.append(loss)
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        ahead, wide = first / (1 - 0.9**t), second / (1 - 0.999**t)
        flat = flat - rate * (ahead / (np.sqrt(wide) + 1e-8) + decay * flat)
    data.unpersist()
    return unflatten(flat, layers), losses


def score(df: DataFrame, vector: str, layers: Layers, activation: str = "relu", out: str = "logits") -> DataFrame:
    """Append the network's output per row, batch by batch with broadcast weights; a NULL vector gives NULL."""
    shared = df.sparkSession.sparkContext.broadcast((layers, activation))
    names = df.columns
    schema = T.StructType([*df.schema, T.StructField(out, T.ArrayType(T.DoubleType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layers, activation = shared.value
        for b in batches:
            if b.num_rows:
                valid = b.column(vector).is_valid().to_numpy(zero_copy_only=False)
                width = layers[-1][1].size
                result = forward(_matrix(_whole(b, vector), vector), layers, activation) if valid.any() else np.empty((0, width))
                ends = pa.array(np.concatenate([[0], np.cumsum(valid) * width]), pa.int32())
                done = pa.ListArray.from_arrays(ends, pa.array(result.ravel()), mask=pa.array(~valid))
                yield pa.RecordBatch.from_arrays([*b.columns, done], names=[*names, out])

    return df.mapInArrow(work, schema)


def classify(df: DataFrame, vector: str, layers: Layers, activation: str = "relu") -> DataFrame:
    """Logits, probabilities and predicted class from one pass."""
    scored = score(df, vector, layers, activation)
    return scored.withColumns({"probs": softmax("logits"), "pred": argmax("logits")})


def weights_table(df: DataFrame, layers: Layers) -> DataFrame:
    """(layer, row, col, value); the bias is row -1."""
    rows = []
    for i, (w, b) in enumerate(layers):
        rows += [(i, r, c, float(w[r, c])) for r in range(w.shape[0]) for c in range(w.shape[1])]
        rows += [(i, -1, c, float(v)) for c, v in enumerate(b)]
    return df.sparkSession.createDataFrame(rows, "layer int, row int, col int, value double")


def layers_of(table: DataFrame) -> Layers:
    """Weights table back to arrays; its size is the network's, not the data's."""
    cells: dict[int, list] = {}
    for layer, row, col, value in table.select("layer", "row", "col", "value").collect():
        cells.setdefault(layer, []).append((row, col, value))
    out = []
    for layer in sorted(cells):
        rows, cols = (max(c[k] for c in cells[layer]) + 1 for k in (0, 1))
        w, b = np.zeros((rows, cols)), np.zeros(cols)
        for r, c, v in cells[layer]:
            if r < 0:
                b[c] = v
            else:
                w[r, c] = v
        out.append((w, b))
    return out


def class_mean_table(df: DataFrame, vector: str, label: str) -> DataFrame:
    """Weights of a linear classifier whose columns are the class means (zero bias).

    Means are taken vector-wise; only the k mean vectors are unfolded into cells.
    """
    rows = df.select(F.col(label).cast("int").alias("col"), array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    means = rows.groupBy("col").agg(Summarizer.mean(F.col("v")).alias("m"))
    cells = means.select("col", F.posexplode(vector_to_array("m")).alias("row", "value"))
    return cells.select(F.lit(0).alias("layer"), "row", "col", "value")


def l1_norm(table: DataFrame, strength: float) -> DataFrame:
    return table.agg((F.sum(F.abs("value")) * F.lit(strength)).alias("l1"))


def fit_boosted_trees(df: DataFrame, features: Sequence[str], target: str, rounds: int = 20, depth: int = 5, seed: int = 0) -> PipelineModel:
    parts = [
        VectorAssembler(inputCols=list(features), outputCol="features"),
        GBTRegressor(featuresCol="features", labelCol=target, predictionCol="prediction", maxIter=rounds, maxDepth=depth, seed=seed),
    ]
    return Pipeline(stages=parts).fit(spread(df.select(*features, target)))


def fit_classifier(df: DataFrame, vector: str, label: str, hidden: Sequence[int], classes: int, steps: int = 100, seed: int = 0, start=None):
    """Feed-forward classifier on an array column; ``start`` continues from earlier weights."""
    rows = spread(df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label"))).persist()
    width = rows.select(F.max(F.size(vector_to_array("features")))).first()[0]
    net = MultilayerPerceptronClassifier(layers=[width, *hidden, classes], maxIter=steps, seed=seed)
    model = (net.setInitialWeights(start) if start is not None else net).fit(rows)
    rows.unpersist()
    return model


def window_moments(rows: DataFrame, vector: str, targets: Sequence[str], shift: np.ndarray) -> np.ndarray:
    """Sums of products of (1, features, targets) less ``shift``, over all rows.

    Each task adds up the products of its own rows; the sums meet per cell in a shuffle, so the driver gets one matrix.
    """
    targets = list(targets)
    shared = rows.sparkSession.sparkContext.broadcast(shift)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            b, x, y = _known_rows(b, vector, targets)
            if b.num_rows:
                z = np.hstack([np.ones((b.num_rows, 1)), np.hstack([x, y]) - shared.value])
                total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["i", "v"])

    sums = rows.select(vector, *targets).mapInArrow(work, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    flat = np.array([v for _, v in sorted(map(tuple, sums.collect()))])
    shared.unpersist()
    return flat.reshape(len(shift) + 1, -1)


def least_squares(moments: np.ndarray, targets: int, penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights per target on centred features, and the means of features and of targets (of shifted values).

    ``penalty`` counts on features of unit variance, as a share of the rows; features without variance weigh nothing.
    """
    means = moments[0, 1:] / moments[0, 0]
    covariance = moments[1:, 1:] / moments[0, 0] - np.outer(means, means)
    k = len(means) - targets
    wide = np.sqrt(np.maximum(np.diag(covariance)[:k], 0))
    wide = np.where(wide > 1e-9 * np.sqrt(np.maximum(np.diag(moments)[1 : k + 1] / moments[0, 0], 1e-300)), wide, np.inf)
    scaled = covariance[:k, :k] / np.outer(wide, wide) + penalty * np.eye(k)
    weights = np.linalg.lstsq(scaled, covariance[:k, k:] / wide[:, None], rcond=1e-13)[0] / wide[:, None]
    return weights, means[:k], means[k:]


def forecast(
    series: DataFrame, order: Sequence[str], features: Sequence[str], targets: Sequence[str], window: int = 60, horizon: int = 1, penalty: float = 1e-6, block: int = 8192, **sizes
) -> DataFrame:
    """Fit one linear model per target on the flattened windows of the first 80 %, report RMSE.

    Also reports the error of predicting the training mean, as a yardstick. All targets are fitted from one pass over the
    training windows and judged in a second one over all of them. Windows with a missing value are left out; without a
    whole training window there is no row.
    """
    # rows are numbered once; the split follows from the numbers, before any window is built
    numbered = stage(scan(series, order, rank="__at", **sizes), "forecast-rows")
    whole = max(0, numbered.count() - window - (horizon + 1))
    last_train = window + whole - math.ceil(0.2 * whole)
    centre = numbered.agg(*[F.coalesce(F.avg(known(F.col(c).cast("double"))), F.lit(0.0)) for c in (*features, *targets)]).first()
    shift = np.array([*list(centre[: len(features)]) * window, *centre[len(features) :]])
    rows = sliding_windows(numbered, order, features, targets, window, horizon, index="__at", block=block)
    flat = F.flatten(F.transform("window", lambda r: F.array(*[F.coalesce(r[f].cast("double"), F.lit(math.nan)) for f in features])))
    names = [f"y_{t}" for t in targets]
    goals = [F.col("target")[t].cast("double").alias(n) for t, n in zip(targets, names)]
    part = F.when(F.col("__at") <= last_train, "train").otherwise("test")
    rows = rows.select(flat.alias("features"), *goals, part.alias("split")).persist()
    moments = window_moments(rows.filter("split = 'train'"), "features", names, shift)
    out = "target string, split string, n bigint, rmse double, mean_rmse double"
    if not moments.size:
        rows.unpersist()
        return series.sparkSession.createDataFrame([], out)
    weights, x_means, y_means = least_squares(moments, len(targets), penalty)
    y_means = y_means + shift[-len(targets) :]
    fitted = _linear(rows, "features", names, "split", weights, y_means - (x_means + shift[: -len(targets)]) @ weights)
    misses = [F.struct(F.lit(t).alias("target"), (F.col(n) - F.col("fitted")[i]).alias("e"), (F.col(n) - F.lit(float(y_means[i]))).alias("m")) for i, (t, n) in enumerate(zip(targets, names))]
    each = fitted.select("split", F.explode(F.array(*misses)).alias("v")).select("split", "v.*")
    found = each.groupBy("target", "split").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("e") ** 2)).alias("rmse"), F.sqrt(F.avg(F.col("m") ** 2)).alias("mean_rmse")).collect()
    rows.unpersist()
    return series.sparkSession.createDataFrame([tuple(r) for r in found], out)


def _linear(rows: DataFrame, vector: str, kept: Sequence[str], split: str, weights: np.ndarray, bias: np.ndarray) -> DataFrame:
    """(split, kept..., fitted) without the vectors, which need not come back from the tasks."""
    shared, kept = rows.sparkSession.sparkContext.broadcast((weights, bias)), list(kept)
    schema = T.StructType([*[rows.schema[c] for c in (split, *kept)], T.StructField("fitted", T.ArrayType(T.DoubleType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for b in batches:
            b, x, _ = _known_rows(b, vector, kept)
            if b.num_rows:
                ends = pa.array(np.arange(b.num_rows + 1) * bias.size, pa.int32())
                done = pa.ListArray.from_arrays(ends, pa.array((x @ weights + bias).ravel()))
                yield pa.RecordBatch.from_arrays([b.column(c) for c in (split, *kept)] + [done], names=[split, *kept, "fitted"])

    return rows.select(split, *kept, vector).mapInArrow(work, schema)


def _known_rows(batch: pa.RecordBatch, vector: str, numbers: Sequence[str]) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    """The rows without a missing value or NaN, with their vectors and numbers as matrices."""
    batch = _whole(batch, vector, *numbers)
    if not batch.num_rows:
        return batch, np.empty((0, 0)), np.empty((0, 0))
    x, y = _matrix(batch, vector), np.column_stack([batch.column(c).to_numpy() for c in numbers])
    valid = ~(np.isnan(x).any(axis=1) | np.isnan(y).any(axis=1))
    return (batch, x, y) if valid.all() else (batch.filter(pa.array(valid)), x[valid], y[valid])


def model_table(df: DataFrame, y: str, preds: dict[str, str], split: str) -> DataFrame:
    """(model, split, metrics) for several prediction columns in one pass."""
    shown = F.array(*[F.struct(F.lit(m).alias("model"), F.col(p).cast("double").alias("p")) for m, p in preds.items()])
    rows = df.select(F.col(split).alias("split"), F.col(y).alias("y"), F.explode(shown).alias("m")).select("split", "y", "m.*")
    return regression_metrics(rows, "y", "p", ["model", "split"])
