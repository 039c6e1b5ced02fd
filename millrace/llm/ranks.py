"""Gapless places of rows in groups of any size."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import stage

ROWS_PER_RANGE = 1_000_000


def placed(rows: DataFrame, group: str, order: Sequence[str], name: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Adds each row's place in its group, from 0 without gaps, in the given order (null first; ties share out
    neighbouring places).

    Rows go into ranges of (group, order, own number), so that a group with a third of all rows, or a key in it, is
    spread over many ranges. Their number follows the rows, so a range stays near ``rows_per_range``. A range's counts per group are all that crosses ranges. Rows and ranges are stored, so a
    place never depends on a task that is run again. Null is a group like others.
    """
    names = rows.columns
    own = {c: f"c{i}" for i, c in enumerate(names)}  # no column of the rows can clash with those added here
    keys = [own[group], *(own[c] for c in order), "_row"]
    numbered = stage(rows.toDF(*own.values()).withColumn("_row", F.monotonically_increasing_id()), "place-rows")
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, math.ceil(numbered.count() / rows_per_range))  # the count comes from the files' footers
    ranged = stage(numbered.repartitionByRange(parts, *keys).withColumn("_range", F.spark_partition_id()), "place-ranges")
    counts = ranged.groupBy(F.col(keys[0]).alias("_group"), F.col("_range").alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_group", "_part", (F.sum("_n").over(Window.partitionBy("_group").orderBy("_part")) - F.col("_n")).alias("_before"))
    at = ranged.withColumn("_at", F.row_number().over(Window.partitionBy(keys[0], "_range").orderBy(*keys[1:])) - 1)
    joined = at.join(before, F.col(keys[0]).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_part")))
    return joined.select(*(F.col(x).alias(c) for c, x in own.items()), (F.col("_at") + F.col("_before")).alias(name))
