"""Cleaning and imputation of dirty tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.lookup import one_row
from millrace.operators.ordered import fill_within_key
from millrace.operators.quantiles import exact_quantiles
from millrace.session import stage

# Fixed pattern: optional sign, decimal digits, optional exponent; surrounding blanks allowed.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def to_numeric(c: str | Column) -> Column:
    """Text to double; anything that is not a plain number becomes NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def fit_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row, one exact median per column."""
    medians = exact_quantiles(df, {c: [0.5] for c in columns})
    schema = ", ".join(f"`{c}` double" for c in columns)
    return df.sparkSession.createDataFrame([tuple(medians[c][0] for c in columns)], schema)


def fill_with(df: DataFrame, stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    row = one_row(stats)
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), row[c]) for c in columns})


def recode(c: str | Column, codes: Mapping) -> Column:
    """Dictionary recode; unknown and NULL become NULL."""
    c = F.col(c) if isinstance(c, str) else c
    pairs = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    return F.try_element_at(pairs, c)


def within(c: str | Column, low: float | Column | None = None, high: float | Column | None = None) -> Column:
    """Values outside the inclusive bounds become NULL; either side may be open."""
    c = F.col(c) if isinstance(c, str) else c
    keep = F.lit(True)
    if low is not None:
        keep = keep & (c >= low)
    if high is not None:
        keep = keep & (c <= high)
    return F.when(keep, c)


def drop_out_of_range(df: DataFrame, bounds: Mapping[str, tuple]) -> DataFrame:
    return df.withColumns({c: within(c, low, high) for c, (low, high) in bounds.items()})


def fit_fences(train: DataFrame, upper: Mapping[str, float], lower: float = 1.5) -> DataFrame:
    """One row of IQR fences ``<col>_low`` / ``<col>_high``; the upper reach differs by column."""
    quartiles = exact_quantiles(train, {c: [0.25, 0.75] for c in upper})
    values, names = [], []
    for c, reach in upper.items():
        q1, q3 = quartiles[c]
        known = q1 is not None
        values += [q1 - lower * (q3 - q1) if known else None, q3 + reach * (q3 - q1) if known else None]
        names += [f"`{c}_low` double", f"`{c}_high` double"]
    return train.sparkSession.createDataFrame([tuple(values)], ", ".join(names))


def apply_fences(df: DataFrame, fences: DataFrame, columns: Sequence[str]) -> DataFrame:
    row = one_row(fences)
    return df.withColumns({c: within(c, row[f"{c}_low"], row[f"{c}_high"]) for c in columns})


def fill_by_key(df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str], residual: bool = True, **sizes) -> DataFrame:
    """Per-key forward then backward fill; what stays missing gets the median if ``residual``."""
    filled = fill_within_key(df, key, order, columns, **sizes)
    if not residual:
        return filled
    filled = stage(filled, "filled")  # the medians and the result read it; the fill shuffles once
    return fill_with(filled, fit_medians(filled, columns), columns)


def missing_list_to_empty(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, F.array().cast("array<string>"))


def months_of(c: str | Column) -> Column:
    """'22 Years and 1 Months' to months; either part may be absent, missing text is 0."""
    c = F.col(c) if isinstance(c, str) else c

    def part(unit: str) -> Column:
        digits = F.regexp_extract(c, rf"(\d+)\s{unit}", 1)
        return F.coalesce(F.nullif(digits, F.lit("")).try_cast("int"), F.lit(0))

    return part("Years") * 12 + part("Months")


def flags_to_int(df: DataFrame) -> DataFrame:
    flags = [f.name for f in df.schema if f.dataType.typeName() == "boolean"]
    return df.withColumns({c: F.col(c).cast("int") for c in flags}) if flags else df
