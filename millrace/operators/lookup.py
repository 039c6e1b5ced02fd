"""Dictionary lookups, memberships and one-row statistics as joins and subqueries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import stage


def lookup(df: DataFrame, dim: DataFrame, on: Sequence[str], values: Sequence[str], order: str | None = None) -> DataFrame:
    """Left lookup: unknown keys keep their row and get NULL.

    A key that the side has more than once counts as one entry: the last in ``order``, or
    without an order any one entry as a whole. How to join is left to the size of the side.
    """
    return df.join(one_each(dim, on, values, order), list(on), "left")


def one_each(dim: DataFrame, on: Sequence[str], values: Sequence[str], order: str | None = None) -> DataFrame:
    """One row per key."""
    entry = F.struct(*values)
    return dim.groupBy(*on).agg((F.max_by(entry, order) if order else F.max(entry)).alias("__v")).select(*on, "__v.*")


def last_wins(dim: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """One row per key, the last in ``order``: what building a dictionary row by row gives."""
    return one_each(dim, [key], [value], order)


def replace_values(df: DataFrame, dim: DataFrame, key: str, value: str, columns: Sequence[str] | None = None, order: str | None = None) -> DataFrame:
    """Replace every cell equal to a key, in all string columns unless told otherwise.

    Unknown values survive; replaced values are not replaced again. Of a repeated key the
    last entry in ``order`` counts, or else the greatest value.
    """
    columns = columns or [f.name for f in df.schema if f.dataType.typeName() == "string"]
    dim, out = one_each(dim, [key], [value], order), df
    for i, c in enumerate(columns):
        side = dim.select(F.col(key).alias(f"__k{i}"), F.col(value).alias(f"__v{i}"))
        out = out.join(side, F.col(c) == F.col(f"__k{i}"), "left")
    new = {c: F.coalesce(f"__v{i}", c) for i, c in enumerate(columns)}
    return out.withColumns(new).select(*df.columns)


def replace_cells(df: DataFrame, dim: DataFrame, key: str, value: str, columns: Sequence[str] | None = None, order: str | None = None) -> DataFrame:
    """As ``replace_values``, with one join for all columns, for tables with many of them and a dictionary too large to
    be sent to every task.

    Rows are numbered and stored. Their cells meet the dictionary as (row, column, value), only those found go back to
    their row, so what is moved does not grow with the number of columns that have nothing to replace.
    """
    columns = columns or [f.name for f in df.schema if f.dataType.typeName() == "string"]
    if not columns:
        return df
    dim = one_each(dim, [key], [value], order).select(F.col(key).alias("__old"), F.col(value).alias("__new"))
    rows = stage(df.withColumn("__row", F.monotonically_increasing_id()), "cell-rows")
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("at"), F.col(c).alias("v")) for i, c in enumerate(columns)]))
    cells = rows.select("__row", cells.alias("c")).filter("c.v is not null")
    hits = cells.join(dim, F.col("c.v") == F.col("__old")).groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct("c.at", "__new"))).alias("__cells"))
    out = rows.join(hits, "__row", "left")
    return out.withColumns({c: F.coalesce(F.try_element_at("__cells", F.lit(i)), F.col(c)) for i, c in enumerate(columns)}).select(*df.columns)


def members(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys.select(*on), list(on), "left_semi")


def key_filter(keys: DataFrame, on: Sequence[str], blocks: int) -> DataFrame:
    """One row with a blocked Bloom filter of the keys: an array of ``blocks`` words of 64 bits, built map-side.

    A key sets four bits of the one word its hash names. Tasks join their words by OR before the shuffle, which moves
    at most one row for each word and task.
    """
    held = keys.select(_word(on, blocks).alias("at"), _mask(on).alias("bits")).groupBy("at").agg(F.bit_or("bits").alias("bits"))
    places = keys.sparkSession.range(blocks).select(F.col("id").alias("at"))
    words = places.join(held, "at", "left").select(F.struct("at", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits")).alias("w"))
    return words.agg(F.transform(F.array_sort(F.collect_list("w")), lambda w: w["bits"]).alias("words"))


def _word(on: Sequence[str], blocks: int) -> Column:
    return F.pmod(F.xxhash64(*on), F.lit(blocks).cast("bigint"))


def _mask(on: Sequence[str]) -> Column:
    other, out = F.xxhash64(F.lit(1), *on), None
    for i in range(4):
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(other, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
        out = bit if out is None else out.bitwiseOR(bit)
    return out


def members_filtered(df: DataFrame, keys: DataFrame, on: Sequence[str], most_blocks: int = 1 << 20) -> DataFrame:
    """As ``members``, for key tables too large to be sent to every task: rows whose key is certainly not among them fall
    out before the shuffle, the rest meets the keys in the exact semi join.

    The filter has about 16 bits a key and one key in some hundred passes wrongly. It never has more than ``most_blocks``
    words (8 MB, the bound of what each task gets); with more keys than that more rows pass, the result stays the same.
    A row with a missing key is no member. Key columns must have the same types on both sides, as they are hashed.
    """
    types = [[d.schema[c].dataType.simpleString() for c in on] for d in (df, keys)]
    if types[0] != types[1]:
        raise ValueError(f"key types differ: {types[0]} and {types[1]}")
    held = stage(keys.select(*on).dropna(subset=list(on)).distinct(), "filter-keys")
    blocks = min(most_blocks, 1 << max(10, (held.count() // 4).bit_length()))
    words = key_filter(held, on, blocks).scalar()
    mask = _mask(on)
    hit = F.get(words, _word(on, blocks).cast("int")).bitwiseAND(mask) == mask
    return df.filter(hit).join(held, list(on), "left_semi")


def one_row(stats: DataFrame) -> Column:
    """A one-row table as a scalar subquery; fields by ``[name]``.

    No join is planned: the row is computed once and enters each expression as a constant.
    """
    return stats.select(F.struct("*").alias("stats")).scalar()


def both_sides(matches: DataFrame, ratings: DataFrame, on: Sequence[str], home: str, away: str, value: str) -> DataFrame:
    """Look up a value for the home and for the away side."""
    ratings = one_each(ratings, [*on, "team"], [value])
    for role, side in (("home", home), ("away", away)):
        dim = ratings.select(*on, F.col("team").alias(side), F.col(value).alias(f"{role}_{value}"))
        matches = matches.join(dim, [*on, side], "left")
    return matches


def label_union(df: DataFrame, *columns: str) -> DataFrame:
    """Every label that occurs in any of the columns, sorted."""
    return df.select(F.explode(F.array(*[F.col(c).cast("bigint") for c in columns])).alias("label")).distinct().orderBy("label")
