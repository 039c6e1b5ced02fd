"""Ordered work without a one-partition window.

Rows are written once, dealt into contiguous key ranges, each with the number of its range
("bucket"). The number is stored with the row, so a task that runs again finds every row in
the same bucket. Each bucket is windowed on its own; what crosses a boundary (counts, sums,
last known values) comes from a table of totals per bucket, which is as small as the number
of buckets. Ranges run over partition and order columns together, so one hot key is spread
over as many buckets as its share of the rows asks for. The source of the rows is read once.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.lookup import members
from millrace.session import stage

BUCKET = "__bucket"
WHOLE = "__whole"
ROWS_PER_BUCKET = 1_000_000
UNDEALT = 8  # a table of at most this part of a range is windowed as it is


def _stored(df: DataFrame, stored: bool) -> DataFrame:
    """The rows as a stored table, with a constant column; ``stored`` says that ``df`` is one already."""
    rows = df.withColumn(WHOLE, F.lit(0))
    return rows if stored else stage(rows, "ordered-rows")


def _dealt(rows: DataFrame, partition: Sequence[str], order: Sequence[str], rows_per_bucket: int) -> DataFrame:
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(least, math.ceil(rows.count() / rows_per_bucket))  # the count comes from the files' footers
    return stage(rows.repartitionByRange(buckets, *partition, *order).withColumn(BUCKET, F.spark_partition_id()), "ordered-ranges")


def range_buckets(df: DataFrame, partition: Sequence[str], order: Sequence[str], rows_per_bucket: int = ROWS_PER_BUCKET, stored: bool = False) -> DataFrame:
    """The rows, stored in key ranges of about ``rows_per_bucket``; adds the range's number and a constant column.

    ``stored`` says that ``df`` is a stored table already, which can be read as often as a copy of it."""
    return _dealt(_stored(df, stored), partition, order, rows_per_bucket)


def _spanning(totals: DataFrame, group: Sequence[str]) -> DataFrame:
    """Totals of the groups that reach over several buckets: at most two rows a bucket."""
    spread = totals.groupBy(*group).agg(F.count(F.lit(1)).alias("__b")).filter("__b > 1").drop("__b")
    same = [F.col(g).eqNullSafe(F.col(f"__s_{g}")) for g in group]
    return totals.join(spread.select(*[F.col(g).alias(f"__s_{g}") for g in group]), same, "left_semi")


def _attach(rows: DataFrame, carried: DataFrame, group: Sequence[str]) -> DataFrame:
    """Left-join what earlier or later buckets hold of a group. The side is stored, so its size is known to the join."""
    side = stage(carried, "ordered-carry")
    side = side.select(F.col(BUCKET).alias("__cb"), *[F.col(g).alias(f"__c_{g}") for g in group], *[c for c in side.columns if c not in (BUCKET, *group)])
    match = [F.col(BUCKET) == F.col("__cb"), *[F.col(g).eqNullSafe(F.col(f"__c_{g}")) for g in group]]
    return rows.join(side, match, "left").drop("__cb", *[f"__c_{g}" for g in group])


def scan(
    df: DataFrame,
    order: Sequence[str],
    partition: Sequence[str] = (),
    rank: str | None = "rank",
    sums: dict[str, str] | None = None,
    lows: dict[str, str] | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    stored: bool = False,
) -> DataFrame:
    """1-based rank, running sums and running minima in ``order`` within ``partition``.

    ``order`` must be unique inside a partition for the rank to be reproducible; order
    descending by passing a negated column. ``sums`` and ``lows`` map output name to input
    column; a sum includes the row itself, a low is the least value of the rows before it.
    A ``stored`` table is not copied before it is dealt into ranges. Partitions of a table
    that is a fraction of one range are not dealt either: nothing can reach over a boundary then.
    """
    partition, order, sums, lows = list(partition), list(order), dict(sums or {}), dict(lows or {})
    group = partition or [WHOLE]
    rows = _stored(df, stored)
    if partition and rows.count() <= rows_per_bucket // UNDEALT:
        window = Window.partitionBy(*group).orderBy(*order)
        done = {rank: F.row_number().over(window).cast("bigint")} if rank else {}
        done |= {name: F.sum(c).over(window.rowsBetween(Window.unboundedPreceding, 0)) for name, c in sums.items()}
        done |= {name: F.min(c).over(window.rowsBetween(Window.unboundedPreceding, -1)) for name, c in lows.items()}
        return rows.withColumns(done).select(*df.columns, *[c for c in done if c not in df.columns])
    bucketed = _dealt(rows, partition, order, rows_per_bucket)
    window = Window.partitionBy(BUCKET, *group).orderBy(*order)
    running = window.rowsBetween(Window.unboundedPreceding, 0)
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    own = (
        {"__row": F.row_number().over(window).cast("bigint")}
        | {f"__s{i}": F.sum(c).over(running) for i, c in enumerate(sums.values())}
        | {f"__m{i}": F.min(c).over(before) for i, c in enumerate(lows.values())}
    )
    whole = [F.count(F.lit(1)).alias("__n"), *[F.sum(c).alias(f"__cs{i}") for i, c in enumerate(sums.values())]]
    whole += [F.min(c).alias(f"__cm{i}") for i, c in enumerate(lows.values())]
    totals = bucketed.groupBy(BUCKET, *group).agg(*whole)
    earlier = Window.partitionBy(*group).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.sum(c).over(earlier).alias(c) for c in ["__n", *[f"__cs{i}" for i in range(len(sums))]]]
    carried += [F.min(f"__cm{i}").over(earlier).alias(f"__cm{i}") for i in range(len(lows))]
    out = _attach(bucketed.withColumns(own), _spanning(totals, group).select(BUCKET, *group, *carried), group)
    done = {rank: F.col("__row") + F.coalesce("__n", F.lit(0))} if rank else {}
    done |= {name: F.coalesce(F.col(f"__cs{i}") + F.col(f"__s{i}"), f"__s{i}", f"__cs{i}").cast(out.schema[f"__s{i}"].dataType) for i, name in enumerate(sums)}
    done |= {name: F.least(f"__cm{i}", f"__m{i}") for i, name in enumerate(lows)}
    new = [c for c in done if c not in df.columns]
    return out.withColumns(done).select(*df.columns, *new)


def at_or_below(keys: Sequence[str], last: DataFrame) -> Column:
    """Row filter: composite key at or below the one of a one-row table, compared column by column, NULL first."""
    row = last.select(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]).alias("last")).scalar()

    def below(i: int) -> Column:
        x, y = F.col(keys[i]), row[f"k{i}"]
        if i + 1 == len(keys):
            return F.coalesce(x <= y, x.isNull())
        return F.coalesce(x < y, x.isNull() & y.isNotNull()) | (x.eqNullSafe(y) & below(i + 1))

    return below(0)


def fill_within_key(df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str], rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Forward fill, then backward fill, inside each key in ``order``.

    A key that reaches over several buckets gets the last (first) known value of the
    buckets before (after) it from the table of totals, so its rows stay spread out.
    """
    order, columns = list(order), list(columns)
    bucketed = range_buckets(df, [key], order, rows_per_bucket)
    window = Window.partitionBy(BUCKET, key).orderBy(*order)
    past, future = window.rowsBetween(Window.unboundedPreceding, 0), window.rowsBetween(0, Window.unboundedFollowing)
    local = bucketed.withColumns(
        {f"__f{i}": F.last(c, ignorenulls=True).over(past) for i, c in enumerate(columns)}
        | {f"__b{i}": F.first(c, ignorenulls=True).over(future) for i, c in enumerate(columns)}
    )
    ends = []
    for i, c in enumerate(columns):
        known = F.when(F.col(c).isNotNull(), F.struct(*order))
        ends += [F.max_by(c, known).alias(f"__pf{i}"), F.min_by(c, known).alias(f"__pb{i}")]
    totals = _spanning(bucketed.groupBy(BUCKET, key).agg(*ends), [key])
    by_bucket = Window.partitionBy(key).orderBy(BUCKET)
    before, after = by_bucket.rowsBetween(Window.unboundedPreceding, -1), by_bucket.rowsBetween(1, Window.unboundedFollowing)
    carried = [F.last(f"__pf{i}", ignorenulls=True).over(before).alias(f"__pf{i}") for i in range(len(columns))]
    carried += [F.first(f"__pb{i}", ignorenulls=True).over(after).alias(f"__pb{i}") for i in range(len(columns))]
    local = _attach(local, totals.select(BUCKET, key, *carried), [key])
    filled = {c: F.coalesce(f"__f{i}", f"__pf{i}", f"__b{i}", f"__pb{i}") for i, c in enumerate(columns)}
    return local.withColumns(filled).select(*df.columns)


def sliding_windows(
    df: DataFrame,
    order: Sequence[str],
    features: Sequence[str],
    targets: Sequence[str],
    window: int = 60,
    horizon: int = 1,
    index: str | None = None,
    block: int = 8192,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Each row with the ``window`` rows before it and the target row ``horizon + 1`` after it.

    ``index`` names a gap-free row number if the table has one; otherwise it is ranked.
    Blocks of consecutive rows get a copy of the rows just outside them, so the frames
    are whole and the rows of one series are spread over many tasks.
    """
    ahead = horizon + 1
    block = max(block, window, ahead)
    if index is None:
        df, index = scan(df, order, rank="__index", rows_per_bucket=rows_per_bucket), "__index"
    kept = [c for c in dict.fromkeys([*order, *features, *targets]) if c != index]
    rows = df.select(F.col(index).cast("bigint").alias("__i"), *kept).withColumn("__home", F.floor(F.col("__i") / block))
    inside = F.col("__i") - F.col("__home") * block
    homes = F.array(
        F.col("__home"),
        F.when(inside >= block - window, F.col("__home") + 1),
        F.when(inside < ahead, F.col("__home") - 1),
    )
    copies = rows.withColumn("__block", F.explode(F.array_compact(homes)))
    frame = Window.partitionBy("__block").orderBy("__i")
    shown = copies.select(
        "__home",
        "__block",
        *([F.col("__i").alias(index)] if index != "__index" else []),
        *kept,
        F.collect_list(F.struct(*features)).over(frame.rowsBetween(-window, -1)).alias("window"),
        F.lead(F.struct(*targets), ahead).over(frame).alias("target"),
    )
    whole = (F.col("__home") == F.col("__block")) & (F.size("window") == window) & F.col("target").isNotNull()
    return shown.filter(whole).drop("__home", "__block")


def sort_rows(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    return df.orderBy(*order)


def timeline(history: DataFrame, entities: DataFrame | None, home: str, away: str, values: dict[str, tuple[str, str]], key: Sequence[str] = ()) -> DataFrame:
    """One row per (record, role): the entity and its own side of each value column."""
    roles = [
        F.struct(
            F.lit(role).alias("role"),
            F.col(team).alias("team"),
            *[F.col(pair[side]).alias(name) for name, pair in values.items()],
        )
        for side, (role, team) in enumerate((("home", home), ("away", away)))
    ]
    rest = [c for c in history.columns if c not in {home, away, *[c for p in values.values() for c in p]}]
    out = history.select(*rest, F.explode(F.array(*roles)).alias("__r")).select(*rest, "__r.*")
    return out if entities is None else members(out, entities, [*key, "team"])


def best_per_period(df: DataFrame, period: Column, value: str, earlier: Sequence[Column], keep: Sequence[Column]) -> DataFrame:
    """The record with the highest value per period; the first record wins ties.

    ``earlier`` are numeric order columns; partial ``max_by`` states meet in the shuffle,
    so a period that holds most rows still costs one row per task.
    """
    rank = F.struct(F.col(value), *[-c for c in earlier])
    return df.groupBy(period.alias("period")).agg(F.max_by(F.struct(*keep), rank).alias("__b")).select("period", "__b.*")
