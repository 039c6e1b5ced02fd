"""Model evaluation from labels and scores that stay distributed.

Curves, areas and average precision work on counts per distinct score, which are added
up map-side first; the running totals over scores come from the ordered scan, so no
class and no score range is ever sorted in one task. ``bins`` rounds scores in [0, 1]
down to a fixed grid when an approximate curve is enough.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.vectors import log_sum_exp, softmax
from millrace.operators.lookup import lookup, one_row
from millrace.operators.ordered import ROWS_PER_BUCKET, scan
from millrace.session import stage


def accuracy(df: DataFrame, label: str, pred: str) -> DataFrame:
    return df.agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"))


def observed(df: DataFrame, label: str, pred: str) -> DataFrame:
    """(label, pred, n) of the pairs that occur."""
    return df.groupBy(F.col(label).cast("bigint").alias("label"), F.col(pred).cast("bigint").alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def confusion(df: DataFrame, label: str, pred: str) -> DataFrame:
    """(label, pred, n) over the whole grid of labels seen on either side: k * k rows, as a shown grid has them."""
    return grid(observed(df, label, pred))


def grid(cells: DataFrame) -> DataFrame:
    """The cells that occur and those that don't, with 0."""
    seen = cells.select(F.explode(F.array("label", "pred")).alias("c")).agg(F.array_sort(F.collect_set("c")).alias("cs"))
    whole = seen.select(F.explode("cs").alias("label"), "cs").select("label", F.explode("cs").alias("pred"))
    return whole.join(cells, ["label", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def report(cells: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy and the two averages.

    Input is the observed cells (the grid with its zeros gives the same), so the data is not
    read again; 0 where a denominator is 0.
    """
    hit = F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(F.lit(0))
    parts = F.array(
        F.struct(F.col("label").alias("c"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"), hit.alias("tp")),
        F.struct(F.col("pred").alias("c"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("tp")),
    )
    sums = cells.select(F.explode(parts).alias("p")).select("p.*").groupBy("c").agg(*[F.sum(x).alias(x) for x in ("support", "predicted", "tp")])
    per_class = sums.select(
        F.col("c").cast("string").alias("name"),
        "support",
        F.coalesce(F.try_divide("tp", "predicted"), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide("tp", "support"), F.lit(0.0)).alias("recall"),
        F.coalesce(F.try_divide(F.col("tp") * 2, F.col("support") + F.col("predicted")), F.lit(0.0)).alias("f1"),
    )
    metrics = ("precision", "recall", "f1")

    def entry(name: Column, weight: Column, values: Sequence[str]) -> Column:
        return F.struct(
            name.alias("name"), weight.cast("double").alias("w"), *[F.col(v).alias(m) for m, v in zip(metrics, values)], F.col("support")
        )

    entries = F.array(
        entry(F.col("name"), F.lit(1.0), metrics),
        entry(F.lit("accuracy"), F.col("support"), ("recall",) * 3),  # recall weighted by support
        entry(F.lit("macro avg"), F.lit(1.0), metrics),
        entry(F.lit("weighted avg"), F.col("support"), metrics),
    )
    return (
        per_class.select(F.explode(entries).alias("e"))
        .select("e.*")
        .groupBy("name")
        .agg(*[(F.sum(F.col(m) * F.col("w")) / F.sum("w")).alias(m) for m in metrics], F.sum("support").alias("support"))
    )


def one_vs_rest(df: DataFrame, label: str, scores: str) -> DataFrame:
    """(class, y, score): one row per class decision."""
    return df.select(F.col(label).alias("__l"), F.posexplode(scores).alias("class", "score")).select(
        F.col("class").cast("bigint").alias("class"), (F.col("__l") == F.col("class")).cast("int").alias("y"), "score"
    )


def score_counts(df: DataFrame, y: str, score: str, key: Sequence[str] = (), bins: int | None = None) -> DataFrame:
    """Positives and negatives per distinct score, written once for the passes that follow."""
    value = F.col(score).cast("double") if bins is None else F.floor(F.col(score) * bins) / F.lit(float(bins))
    counted = df.groupBy(*key, value.alias("score")).agg(
        F.sum(F.col(y)).cast("bigint").alias("pos"), F.sum(1 - F.col(y)).cast("bigint").alias("neg")
    )
    return stage(counted.withColumn("__down", -F.col("score")), "score-counts")


def pooled(counts: DataFrame) -> DataFrame:
    """Counts of all keys together (micro averages), from the counts per key."""
    return stage(counts.groupBy("score", "__down").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "pooled-counts")


def _with_totals(counts: DataFrame, key: Sequence[str], rows_per_bucket: int) -> tuple[DataFrame, DataFrame]:
    totals = counts.groupBy(*key).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    ranked = scan(counts, ["__down"], key, rank=None, sums={"tp": "pos", "fp": "neg"}, rows_per_bucket=rows_per_bucket, stored=True).drop("__down")
    if key:
        return lookup(ranked, totals, key, ["P", "N"]), totals
    row = one_row(totals)
    return ranked.withColumns({"P": row["P"], "N": row["N"]}), totals


def roc_curve(counts: DataFrame, key: Sequence[str] = (), rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score, with the leading point (infinity, 0, 0)."""
    ranked, totals = _with_totals(counts, key, rows_per_bucket)
    points = ranked.select(*key, F.col("score").alias("threshold"), F.try_divide("fp", "N").alias("fpr"), F.try_divide("tp", "P").alias("tpr"))
    first = totals.select(*key, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(first)


def pr_curve(counts: DataFrame, key: Sequence[str] = (), rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """(threshold, precision, recall), with the closing point (NULL, 1, 0)."""
    ranked, totals = _with_totals(counts, key, rows_per_bucket)
    points = ranked.select(
        *key,
        F.col("score").alias("threshold"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.coalesce(F.try_divide("tp", "P"), F.lit(1.0)).alias("recall"),
    )
    last = totals.select(*key, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return points.unionByName(last)


def areas(counts: DataFrame, key: Sequence[str] = (), rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """ROC AUC (ties count half) and average precision, per key.

    AUC is NULL for a key that lacks one of the two classes, as it is undefined there.
    """
    ranked, _ = _with_totals(counts, key, rows_per_bucket)
    pairs = F.col("neg").cast("double") * (F.col("tp") - F.col("pos") + F.col("pos") / F.lit(2.0))
    step = F.try_divide("pos", "P") * F.col("tp") / (F.col("tp") + F.col("fp"))
    return ranked.groupBy(*key).agg(
        F.try_divide(F.sum(pairs), F.max("P").cast("double") * F.max("N")).alias("auc"),
        F.coalesce(F.sum(step), F.lit(0.0)).alias("ap"),
    )


def area_bounds(counts: DataFrame, key: Sequence[str] = (), rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``auc_low`` and ``auc_high`` per key, from counts per bin of the score (``score_counts`` with ``bins``).

    Binned counts of parts of a table add up to those of all of it, and their number does not grow with the rows. What
    a bin hides is the order of its own positives and negatives: at worst all of its negatives rank above its
    positives, at best below, and the exact area lies between. NULL for a key that lacks one of the two classes.
    """
    ranked, _ = _with_totals(counts, key, rows_per_bucket)
    below = F.col("neg").cast("double")
    all_pairs = F.max("P").cast("double") * F.max("N")
    return ranked.groupBy(*key).agg(
        F.try_divide(F.sum(below * (F.col("tp") - F.col("pos"))), all_pairs).alias("auc_low"),
        F.try_divide(F.sum(below * F.col("tp")), all_pairs).alias("auc_high"),
    )


def merged_counts(*parts: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """Counts of several parts of a table (days, files) added up."""
    both = reduce(DataFrame.unionByName, parts)
    added = both.groupBy(*key, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return stage(added.withColumn("__down", -F.col("score")), "merged-counts")


def best_threshold(curve: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """The threshold with the largest tpr - fpr, the highest one on ties."""
    return curve.groupBy(*key).agg(
        F.max_by(F.struct("threshold", "fpr", "tpr"), F.struct(F.col("tpr") - F.col("fpr"), F.col("threshold"))).alias("b")
    ).select(*key, "b.*")


def relabel(df: DataFrame, score: str, threshold: Column, inclusive: bool = False) -> DataFrame:
    above = F.col(score) >= threshold if inclusive else F.col(score) > threshold
    return df.withColumn("pred", above.cast("int"))


def regression_metrics(df: DataFrame, y: str, pred: str, key: Sequence[str] = ()) -> DataFrame:
    """MSE, RMSE, MAE, R2 and Pearson correlation in one pass."""
    y_, error = F.col(y), F.col(y) - F.col(pred)
    return df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(error * error).alias("mse"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        (F.lit(1.0) - F.try_divide(F.sum(error * error), F.count(F.lit(1)) * F.var_pop(y_))).alias("r2"),
        F.corr(y_, F.col(pred)).alias("pearson"),
    )


def cross_entropy(logits: str, label: str) -> Column:
    """Per-row loss: log of the summed exponentials minus the true class's logit."""
    return log_sum_exp(logits) - F.get(F.col(logits), F.col(label).cast("int"))


def focal(ce: Column, alpha: float = 1.0, gamma: float = 2.0) -> Column:
    return F.lit(alpha) * F.pow(F.lit(1.0) - F.exp(-ce), F.lit(gamma)) * ce


def weighted_cross_entropy(df: DataFrame, logits: str, label: str, weights: DataFrame) -> DataFrame:
    """(ce, weighted_ce): plain mean, and the mean weighted by class weight (label, weight)."""
    rows = df.select(F.col(label).alias("label"), cross_entropy(logits, label).alias("ce"))
    rows = lookup(rows, weights, ["label"], ["weight"])
    return rows.agg(F.avg("ce").alias("ce"), (F.sum(F.col("ce") * F.col("weight")) / F.sum("weight")).alias("weighted_ce"))


def combined_loss(
    df: DataFrame,
    logits: str,
    label: str,
    shares: tuple[float, float, float] = (0.6, 0.2, 0.2),
    alpha: float = 0.8,
    gamma: float = 1.5,
    eps: float = 1e-7,
) -> DataFrame:
    """Cross-entropy, soft precision and focal loss, and their weighted sum, in one pass.

    Every row counts once for each class, so the per-class means of the row losses all
    equal the overall mean and one grouping by class serves the three losses.
    """
    ce = cross_entropy(logits, label)
    rows = df.select(F.col(label).alias("__l"), ce.alias("ce"), F.posexplode(softmax(logits)).alias("class", "p"))
    hit = (F.col("__l") == F.col("class")).cast("double")
    per_class = rows.groupBy("class").agg(
        F.sum(F.col("p") * hit).alias("tp"),
        F.sum(F.col("p") * (1.0 - hit)).alias("fp"),
        F.avg("ce").alias("ce"),
        F.avg(focal(F.col("ce"), alpha, gamma)).alias("focal"),
    )
    losses = per_class.agg(
        F.avg("ce").alias("ce"),
        F.avg(1.0 - F.col("tp") / (F.col("tp") + F.col("fp") + F.lit(eps))).alias("soft_precision"),
        F.avg("focal").alias("focal"),
    )
    a, b, c = shares
    return losses.withColumn("total", F.lit(a) * F.col("ce") + F.lit(b) * F.col("soft_precision") + F.lit(c) * F.col("focal"))
