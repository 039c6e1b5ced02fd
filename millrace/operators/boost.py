"""Boosted trees of second order: splits are found from sums of gradient and curvature per node, feature and bin.

Rows never leave their task to find a split: each task adds up its own rows, the shuffle adds up at most one row for
each node, feature, bin and task, and the driver gets one row per open node. A tree is a column expression.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.scalar import known
from millrace.operators.quantiles import exact_quantiles
from millrace.session import stage

STAGE_EVERY = 4  # rounds after which the rows are written down with their margins


@dataclass(frozen=True)
class Split:
    """Rows at or below the edge go to node 2k, the others to 2k + 1; missing values have a side of their own."""

    feature: int
    bin: int
    missing_left: bool
    gain: float


@dataclass
class Tree:
    splits: dict[int, Split] = field(default_factory=dict)
    weights: dict[int, float] = field(default_factory=dict)


@dataclass
class Boosted:
    features: list[str]
    edges: list[list[float]]
    trees: list[Tree]
    base: float | None
    logistic: bool = False


def bin_edges(df: DataFrame, features: Sequence[str], bins: int) -> dict[str, list[float]]:
    """Distinct exact quantiles of each feature, to twelve digits; none for a feature without a known value."""
    found = exact_quantiles(df, {f: [i / bins for i in range(1, bins)] for f in features})
    return {f: sorted({float(f"{e:.12g}") for e in found[f] if e is not None}) for f in features}


def _bin(value: Column, edges: Sequence[float], low: int, high: int) -> Column:
    """How many edges lie below the value, by halving."""
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(value <= F.lit(edges[middle]), _bin(value, edges, low, middle)).otherwise(_bin(value, edges, middle + 1, high))


def _binned(feature: str, edges: Sequence[float]) -> Column:
    value = known(F.col(feature).cast("double"))
    return F.when(value.isNull(), F.lit(-1)).otherwise(_bin(value, edges, 0, len(edges)))


def _walk(tree: Tree, left, leaf, node: int = 1) -> Column:
    """The tree as nested conditions; every node stands in it once."""
    if node not in tree.splits:
        return leaf(node)
    return F.when(left(tree.splits[node]), _walk(tree, left, leaf, 2 * node)).otherwise(_walk(tree, left, leaf, 2 * node + 1))


def _left_by_bin(split: Split) -> Column:
    own = F.col("bins")[split.feature]
    return (own <= split.bin) if split.missing_left else own.between(0, split.bin)


def _best_splits(rows: DataFrame, node: Column, scale: float, penalty: float, least_weight: float, least_gain: float):
    """For each open node its sums and its best split, if one is allowed.

    Gains are compared as shares of ``scale`` to ten decimals, so the order in which sums were added does not decide;
    ties go to the earlier feature, the lower bin, then to missing values on the right.
    """
    cells = rows.select(node.alias("node"), "g", "h", F.posexplode("bins").alias("feature", "bin")).filter("node is not null")
    sums = cells.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("node", "feature")  # at most one row per bin
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = sums.select(
        "node", "feature", "bin",
        *[F.sum(c).over(whole).alias(f"{c}_all") for c in "ghn"],
        *[F.coalesce(F.sum(F.when(F.col("bin") < 0, F.col(c))).over(whole), F.lit(0)).alias(f"{c}_missing") for c in "ghn"],
        *[F.sum(F.when(F.col("bin") >= 0, F.col(c))).over(upto).alias(f"{c}_upto") for c in "ghn"],
    )
    sides = F.explode(F.when(F.col("bin") >= 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(None).cast("boolean"))))
    both = parts.withColumn("missing_left", sides)
    both = both.withColumns({f"{c}_left": F.col(f"{c}_upto") + F.when(F.col("missing_left"), F.col(f"{c}_missing")).otherwise(0) for c in "ghn"})
    both = both.withColumns({f"{c}_right": F.col(f"{c}_all") - F.col(f"{c}_left") for c in "ghn"})

    def worth(side: str) -> Column:
        return F.col(f"g_{side}") * F.col(f"g_{side}") / (F.col(f"h_{side}") + F.lit(penalty))

    gain = F.round((worth("left") + worth("right") - worth("all")) / F.lit(scale), 10)
    allowed = (F.col("n_left") > 0) & (F.col("n_right") > 0) & (F.col("h_left") >= least_weight) & (F.col("h_right") >= least_weight) & (gain > least_gain)
    best = F.struct((-gain).alias("loss"), "feature", "bin", "missing_left", "g_left", "h_left")
    return both.groupBy("node").agg(
        F.min(F.when(allowed, best)).alias("best"), F.max(F.when(F.col("feature") == 0, F.col("g_all"))).alias("g"), F.max(F.when(F.col("feature") == 0, F.col("h_all"))).alias("h")
    )


def fit_boosted(
    df: DataFrame, features: Sequence[str], target: str, rounds: int = 20, depth: int = 5, bins: int = 32, rate: float = 0.3, penalty: float = 1.0,
    least_weight: float = 1.0, least_gain: float = 0.0, logistic: bool = False, edges: Mapping[str, Sequence[float]] | None = None,
) -> Boosted:
    """Trees of ``depth`` levels fitted to gradient and curvature of the squared error, or of the log loss of a 0/1 target.

    NULL and NaN features are missing and go to the side of each split that gains more (to the right where a split saw
    none); rows without a target are left out. Without rows ``base`` is None and a constant target needs no tree.
    ``edges`` replaces the exact quantiles the features are binned at, for example by those of stored sketches.
    A leaf weighs -G / (H + penalty) times ``rate``; a split must gain more than ``least_gain`` as a share of the first
    loss, and 5e-11 at least.
    """
    features = list(features)
    y = known(F.col(target).cast("double"))
    data = df.filter(y.isNotNull())
    n, mean, spread = data.agg(F.count(F.lit(1)), F.avg(y), F.var_pop(y)).first()
    if not n:
        return Boosted(features, [[] for _ in features], [], None, logistic)
    base = mean
    if logistic:
        base = math.log(mean / (1 - mean)) if 0 < mean < 1 else math.copysign(math.inf, mean - 0.5)
    if not spread:
        return Boosted(features, [[] for _ in features], [], base, logistic)
    cuts = edges if edges is not None else bin_edges(data, features, bins)
    cuts = [sorted(map(float, cuts[f])) for f in features]
    scale = n * (1.0 if logistic else spread)
    binned = F.array(*[_binned(f, e) for f, e in zip(features, cuts)])
    rows = stage(data.select(binned.alias("bins"), y.alias("y"), F.lit(base).alias("margin")), "boost-rows")
    trees: list[Tree] = []
    for i in range(rounds):
        sloped = _slopes(rows, logistic)
        tree = Tree()
        open_nodes = {1}
        for _ in range(depth):
            spot = _walk(tree, _left_by_bin, lambda k: F.lit(k if k in open_nodes else None).cast("int"))
            found = _best_splits(sloped, spot, scale, penalty, least_weight, least_gain).collect()
            opened = set()
            for r in found:
                if r["node"] == 1:
                    tree.weights[1] = -rate * r["g"] / (r["h"] + penalty)
                if (b := r["best"]) is not None:
                    k = r["node"]
                    tree.splits[k] = Split(b["feature"], b["bin"], b["missing_left"], -b["loss"])
                    for child, g, h in ((2 * k, b["g_left"], b["h_left"]), (2 * k + 1, r["g"] - b["g_left"], r["h"] - b["h_left"])):
                        tree.weights[child] = -rate * g / (h + penalty)
                        opened.add(child)
            open_nodes = opened
            if not opened:
                break
        trees.append(tree)
        rows = rows.withColumn("margin", F.col("margin") + _walk(tree, _left_by_bin, lambda k, t=tree: F.lit(t.weights[k])))
        if (i + 1) % STAGE_EVERY == 0 and i + 1 < rounds:
            rows = stage(rows, "boost-rows")
    return Boosted(features, cuts, trees, base, logistic)


def _slopes(rows: DataFrame, logistic: bool) -> DataFrame:
    if not logistic:
        return rows.select("bins", (F.col("margin") - F.col("y")).alias("g"), F.lit(1.0).alias("h"))
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("margin")))
    return rows.select("bins", (p - F.col("y")).alias("g"), (p * (F.lit(1.0) - p)).alias("h"))


def tree_outputs(model: Boosted) -> list[Column]:
    """What each tree adds to a row, from the features as they are."""

    def left(split: Split) -> Column:
        value, edges = known(F.col(model.features[split.feature]).cast("double")), model.edges[split.feature]
        below = (value <= F.lit(edges[split.bin])) if split.bin < len(edges) else value.isNotNull()
        return F.coalesce(below, F.lit(split.missing_left))

    return [_walk(t, left, lambda k, t=t: F.lit(t.weights[k])) for t in model.trees]


def score_boosted(df: DataFrame, model: Boosted, out: str = "prediction") -> DataFrame:
    """Append the prediction, for the log loss the probability of 1; NULL from a model without rows."""
    total = sum(tree_outputs(model), F.lit(model.base).cast("double"))
    return df.withColumn(out, F.lit(1.0) / (F.lit(1.0) + F.exp(-total)) if model.logistic else total)


def errors_by_round(df: DataFrame, model: Boosted, target: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., round, n, rmse) of the first trees of a squared-error model, 0 for the base alone, in one pass over the rows."""
    steps = F.array(*[c.cast("double") for c in tree_outputs(model)]).cast("array<double>")
    sums = F.aggregate(steps, F.array(F.lit(model.base).cast("double")), lambda done, x: F.concat(done, F.array(F.element_at(done, -1) + x)))
    y = known(F.col(target).cast("double"))
    rows = df.filter(y.isNotNull()).select(*by, y.alias("y"), F.posexplode(sums).alias("round", "p"))
    return rows.groupBy(*by, "round").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg((F.col("y") - F.col("p")) ** 2)).alias("rmse"))


def nodes_table(spark: SparkSession, model: Boosted) -> DataFrame:
    """(tree, node, feature, edge, missing_left, gain, weight): splits with their edge, leaves with their weight; the edge
    of a split that only parts known from missing values is NULL."""
    rows = []
    for i, t in enumerate(model.trees):
        for k in sorted(t.weights):
            if (s := t.splits.get(k)) is None:
                rows.append((i, k, None, None, None, None, t.weights[k]))
            else:
                edges = model.edges[s.feature]
                rows.append((i, k, model.features[s.feature], edges[s.bin] if s.bin < len(edges) else None, s.missing_left, s.gain, None))
    return spark.createDataFrame(rows, "tree int, node int, feature string, edge double, missing_left boolean, gain double, weight double")
