"""Encoding and scaling, each as fit (small stats) and apply (one projection)."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalar import known
from millrace.operators.lookup import one_row
from millrace.operators.ordered import scan
from millrace.session import stage

CELLS_PER_TASK = 1_000_000


def categories(df: DataFrame, columns: Sequence[str]) -> dict[str, list]:
    """Sorted distinct values per column, NULL left out; one pass for all columns.

    Each value becomes a table column, so this is for columns with as few values as a
    table may have columns: ``one_hot_long`` and ``tokens_long`` serve open vocabularies.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns]))
    found = df.select(pairs.alias("p")).select("p.*").filter("v is not null").distinct().collect()
    out = {c: sorted(r["v"] for r in found if r["c"] == c) for c in columns}
    for c in columns:
        if df.schema[c].dataType.typeName() != "string":
            out[c] = sorted(out[c], key=float)
    return out


def one_hot(df: DataFrame, levels: Mapping[str, Sequence], drop_first: bool = True) -> DataFrame:
    """Replace each column by indicator columns ``col_value``; missing gives all false."""
    shown = {
        f"{c}_{v}": F.coalesce(F.col(c).cast("string") == F.lit(v), F.lit(False))
        for c, values in levels.items()
        for v in list(values)[1 if drop_first else 0 :]
    }
    rest = [c for c in df.columns if c not in levels]
    return df.select(*rest, *[e.alias(n) for n, e in shown.items()])


def split_list(c: str | Column, separator: str = ", ", strip_and: bool = False) -> Column:
    """Split on the literal separator; ``strip_and`` drops a leading 'and ' of a token."""
    c = F.col(c) if isinstance(c, str) else c
    parts = F.split(c, "\\Q" + separator + "\\E")
    return F.transform(parts, lambda t: F.regexp_replace(t, "^and ", "")) if strip_and else parts


def one_hot_long(df: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(key, column, value) of every known cell: the same encoding for columns with any number of values."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(*key, cells.alias("c")).select(*key, "c.*").filter("value is not null")


def fit_dictionary(df: DataFrame, columns: Sequence[str], cells_per_task: int = CELLS_PER_TASK) -> DataFrame:
    """(column, value, index) of all known values, numbered from 0 by column and value, stored. The numbers come from the
    ordered scan of the distinct values, so a vocabulary of any size never visits the driver or one task. Rows of a
    larger table are stored and dealt anew, so a task drops repeats among about ``cells_per_task`` cells at a time."""
    rows = stage(df.select(*columns).withColumn("__row", F.monotonically_increasing_id()), "dictionary-rows")
    cells = rows.count() * len(columns)  # from the files' footers
    if cells > cells_per_task:
        least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartition(max(least, math.ceil(cells / cells_per_task)), "__row")
    values = one_hot_long(rows, [], columns).distinct()
    return stage(scan(values, ["column", "value"], rank="index").withColumn("index", F.col("index") - 1), "dictionary")


def _often(rows: DataFrame, columns: Sequence[str], support: float) -> DataFrame:
    """(column, value) of all known values in at least a share of ``support`` of the rows, and perhaps of some others, stored."""
    texts = rows.select(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)])
    found = texts.freqItems(texts.columns, max(support, 1e-4))
    lists = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}_freqItems").alias("values")) for i, c in enumerate(columns)]))
    pairs = found.select(lists.alias("c")).select("c.column", F.explode("c.values").alias("value"))
    return stage(pairs.filter("value is not null"), "often")


def encode_open(df: DataFrame, columns: Sequence[str], dictionary: DataFrame, out: str = "indices", cells_per_task: int = CELLS_PER_TASK) -> DataFrame:
    """Adds the places of a row's ones in its sparse indicator vector, ascending.

    Rows are numbered and stored; cells of all columns meet the dictionary in one join and come back to their row in
    another, however many columns there are. Values that the dictionary does not hold, and NULL, set no place; every
    row comes out, a row without places with an empty list, and equal rows each by themselves.

    The number of tasks follows the cells, about ``cells_per_task`` each. Of a larger table the values that alone might
    fill a task, a few at most, do not go through the shuffle by value: every task gets their places.
    """
    rows = stage(df.withColumn("__row", F.monotonically_increasing_id()), "open-rows")
    cells = one_hot_long(rows, ["__row"], columns)
    n = rows.count()  # from the files' footers
    if n * len(columns) > cells_per_task:
        least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        tasks = max(least, math.ceil(n * len(columns) / cells_per_task))
        often = F.broadcast(_often(rows, columns, min(cells_per_task / n, 1.0)))
        known = F.broadcast(stage(dictionary.join(often, ["column", "value"]), "often-places"))
        others = cells.join(often, ["column", "value"], "left_anti").repartition(tasks, "column", "value")
        found = others.join(dictionary.repartition(tasks, "column", "value"), ["column", "value"])
        found = found.select("__row", "index").unionByName(cells.join(known, ["column", "value"]).select("__row", "index")).repartition(tasks, "__row")
        rows = rows.repartition(tasks, "__row")
    else:
        found = cells.join(dictionary, ["column", "value"])
    found = found.groupBy("__row").agg(F.sort_array(F.collect_list("index")).alias("__places"))
    places = F.coalesce("__places", F.array().cast("array<bigint>")).alias(out)
    return rows.join(found, "__row", "left").select(*[c for c in df.columns if c != out], places)


def fit_tokens(train: DataFrame, column: str) -> list[str]:
    """Sorted distinct tokens of a list column."""
    return categories(train.select(F.explode(column).alias("token")), ["token"])["token"]


def multi_hot(df: DataFrame, column: str, tokens: Sequence[str], prefix: str = "") -> DataFrame:
    """One 0/1 column per known token; repeats collapse, unknown tokens are ignored."""
    return df.withColumns(
        {f"{prefix}{t}": F.coalesce(F.array_contains(F.col(column), t).cast("int"), F.lit(0)) for t in tokens}
    )


def tokens_long(df: DataFrame, key: Sequence[str], column: str) -> DataFrame:
    """(key, token) pairs without repeats: the same encoding for vocabularies of any size."""
    return df.select(*key, F.explode(F.array_distinct(column)).alias("token"))


def fit_standard(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row of ``<col>_mean`` / ``<col>_std`` (population) of what is known."""
    return df.agg(*[f(known(F.col(c).cast("double"))).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def standardise(df: DataFrame, stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / std; a constant column is only centred."""
    row = one_row(stats)
    scale = {c: F.when(row[f"{c}_std"] == 0, F.lit(1.0)).otherwise(row[f"{c}_std"]) for c in columns}
    return df.withColumns({c: (F.col(c) - row[f"{c}_mean"]) / scale[c] for c in columns})


def unstandardise(df: DataFrame, stats: DataFrame, sources: Mapping[str, str]) -> DataFrame:
    """Back to original units; ``sources`` maps a column to the statistic it was scaled with."""
    row = one_row(stats)
    return df.withColumns({c: F.col(c) * row[f"{s}_std"] + row[f"{s}_mean"] for c, s in sources.items()})


def fit_min_max(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[f(known(F.col(c).cast("double"))).alias(f"{c}_{n}") for c in columns for n, f in (("min", F.min), ("max", F.max))])


def min_max(df: DataFrame, stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Scale to [0, 1] by the fitted range; a constant column becomes 0."""
    row = one_row(stats)
    return df.withColumns(
        {
            c: F.when(row[f"{c}_max"] == row[f"{c}_min"], F.col(c) - row[f"{c}_min"]).otherwise(
                (F.col(c) - row[f"{c}_min"]) / F.nullif(row[f"{c}_max"] - row[f"{c}_min"], F.lit(0.0))
            )
            for c in columns
        }
    )


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): total / count, normalised to sum 1."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    shares = counts.agg(F.sum(F.lit(1.0) / F.col("n")).alias("inverse"))
    return counts.withColumn("weight", F.lit(1.0) / F.col("n") / one_row(shares)["inverse"])


def score_weights(scores: DataFrame, score: str, eps: float = 1e-4) -> DataFrame:
    """Weights 1 / (score + eps), normalised to sum 1."""
    raw = scores.withColumn("raw", F.lit(1.0) / (F.col(score) + F.lit(eps)))
    return raw.withColumn("weight", F.col("raw") / one_row(raw.agg(F.sum("raw").alias("total")))["total"]).drop("raw")


def varied_columns(df: DataFrame, columns: Sequence[str], fast: bool = False) -> list[str]:
    """Columns with more than two distinct values.

    Exact without counting distinct values: more than two means that some value lies
    strictly between the smallest and the largest. ``fast`` uses one pass of sketches.
    """
    values = [known(F.col(c).cast("double")) for c in columns]
    if fast:
        row = df.agg(*[F.approx_count_distinct(v) for v in values]).first()
        return [c for c, k in zip(columns, row) if k > 2]
    ends = df.agg(*[f(v) for v in values for f in (F.min, F.max)]).first()
    between = [F.max((v > F.lit(ends[2 * i])) & (v < F.lit(ends[2 * i + 1]))) for i, v in enumerate(values)]
    return [c for c, seen in zip(columns, df.agg(*between).first()) if seen]


def assemble(columns: Sequence[str], kind: str = "float") -> Column:
    """Model input: one array, down-cast to 32-bit floats by default."""
    return F.array(*[F.col(c).cast(kind) for c in columns])
