"""Projection, filters and table profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import stage

from millrace.functions.scalar import known
from millrace.operators.quantiles import exact_quantiles

NUMERIC = ("byte", "short", "integer", "long", "float", "double", "decimal")


def columns_of_type(df: DataFrame, *kinds: str) -> list[str]:
    """Column names by type name; ``number`` stands for every numeric type. Reads no data."""
    wanted = {k for kind in kinds for k in (NUMERIC if kind == "number" else (kind,))}
    return [f.name for f in df.schema if f.dataType.typeName() in wanted]


def _long(df: DataFrame, columns: Sequence[str], cells: dict[str, Sequence[Column]]) -> DataFrame:
    """One aggregate over all columns, then a row per column."""
    flat = [expr.alias(f"{name}_{i}") for name, exprs in cells.items() for i, expr in enumerate(exprs)]
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column"), *[F.col(f"{name}_{i}").alias(name) for name in cells])
            for i, c in enumerate(columns)
        ]
    )
    return df.agg(*flat).select(F.explode(rows).alias("r")).select("r.*")


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, nulls, any_null) in one pass; NaN counts as missing."""
    columns = list(columns or df.columns)
    floats = columns_of_type(df, "float", "double")
    nulls = [F.count_if(known(c).isNull() if c in floats else F.col(c).isNull()) for c in columns]
    return _long(df, columns, {"nulls": nulls, "any_null": [n > 0 for n in nulls]})


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, n, mean, std, min, q1, median, q3, max); sample std, exact quartiles.

    NULL and NaN are left out of every figure.
    """
    columns = list(columns or columns_of_type(df, "number"))
    quartiles = exact_quantiles(df, {c: [0.25, 0.5, 0.75] for c in columns})

    def fixed(i: int) -> list[Column]:
        return [F.lit(quartiles[c][i]).cast("double") for c in columns]

    values = [known(F.col(c).cast("double")) for c in columns]
    return _long(
        df,
        columns,
        {
            "n": [F.count(v) for v in values],
            "mean": [F.avg(v) for v in values],
            "std": [F.stddev_samp(v) for v in values],
            "min": [F.min(v) for v in values],
            "q1": [F.max(v) for v in fixed(0)],
            "median": [F.max(v) for v in fixed(1)],
            "q3": [F.max(v) for v in fixed(2)],
            "max": [F.max(v) for v in values],
        },
    )


def shape(df: DataFrame) -> DataFrame:
    """(rows, columns)."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)).cast("bigint"))


def types_table(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(i, c, t) for i, (c, t) in enumerate(df.dtypes)], "position bigint, column string, type string")


def head(df: DataFrame, order: Sequence[str | Column], n: int) -> DataFrame:
    """The first ``n`` rows of a stated order; each task keeps ``n`` rows, nothing is fully sorted."""
    return df.orderBy(*order).limit(n)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def align(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Give each table the other's missing columns, filled with 0."""
    add_left = {c: F.lit(0) for c in right.columns if c not in left.columns}
    add_right = {c: F.lit(0) for c in left.columns if c not in right.columns}
    return (left.withColumns(add_left) if add_left else left, right.withColumns(add_right) if add_right else right)


def sort_columns(df: DataFrame) -> DataFrame:
    return df.select(*sorted(df.columns))


def drop_missing(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def min_side(width: str, height: str, size: int) -> Column:
    return F.least(F.col(width), F.col(height)) >= size


def exact_size(width: str, height: str, w: int, h: int) -> Column:
    return (F.col(width) == w) & (F.col(height) == h)


def distinct_sketches(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), bits: int = 14) -> DataFrame:
    """(by..., column, sketch, n): a mergeable sketch of the distinct values of each column in each group, stored.

    Values count as their text, NULL does not count. The relative standard error of an estimate is about 0.8 % at 14
    bits, whatever the groups are that a sketch is put together from.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    pairs = df.select(*by, cells.alias("c")).select(*by, "c.*").filter("value is not null")
    return stage(pairs.groupBy(*by, "column").agg(F.hll_sketch_agg("value", F.lit(bits)).alias("sketch"), F.count(F.lit(1)).alias("n")), "distinct-sketches")


def sketched_distinct(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., column, distinct, n, parts) of the sketches added up over all but ``by``; no row of the table is read."""
    merged = sketches.groupBy(*by, "column").agg(F.hll_union_agg("sketch").alias("sketch"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"))
    return merged.select(*by, "column", F.hll_sketch_estimate("sketch").alias("distinct"), "n", "parts")
