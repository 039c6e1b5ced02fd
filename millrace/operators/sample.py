"""Reproducible splits, shuffles and batches.

Membership is a function of the seed and the row key, so reruns, retries and later
tables agree on which side a row falls.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.scalar import row_hash
from millrace.operators.ordered import BUCKET, ROWS_PER_BUCKET, at_or_below, range_buckets, scan


def hash_split(df: DataFrame, key: str, shares: dict[str, float], seed: int = 0, column: str = "split") -> DataFrame:
    """Assign splits by hash threshold: no shuffle, no count; sizes are close, not exact."""
    digits = F.substring(row_hash(seed, key), 1, 8)
    names, edge, out = list(shares), 0.0, None
    for name in names[:-1]:
        edge += shares[name]
        test = digits < F.lit(f"{round(edge * 2**32):08x}") if round(edge * 2**32) < 2**32 else F.lit(True)
        out = F.when(test, name) if out is None else out.when(test, name)
    return df.withColumn(column, F.lit(names[-1]) if out is None else out.otherwise(names[-1]))


def _hashes_at(df: DataFrame, ranks: Sequence[int], prefix: str = "") -> dict[int, str]:
    """The hash at each 0-based rank, by counting hash prefixes three digits at a time.

    Each level counts at most 4096 prefixes map-side and goes on below those that hold a rank.
    """
    parts = df.groupBy(F.substring("__h", 1, len(prefix) + 3)).agg(F.count(F.lit(1)), F.max("__h")).collect()
    found, below = {}, 0
    for digits, size, highest in sorted(map(tuple, parts)):
        inside = [r for r in ranks if below <= r < below + size]
        if inside and inside == [below + size - 1]:
            found[inside[0]] = highest
        elif inside and len(digits) == 32:
            found.update({r: digits for r in inside})
        elif inside:
            deeper = _hashes_at(df.filter(F.col("__h").startswith(digits)), [r - below for r in inside], digits)
            found.update({r + below: h for r, h in deeper.items()})
        below += size
    return found


def exact_split(df: DataFrame, key: str, cuts: dict[str, int], rest: str, seed: int = 0, column: str = "split") -> DataFrame:
    """Random split with exact sizes over a unique key.

    ``cuts`` maps a split to the rank (in hash order) it ends at. Only the hash at each
    cut is looked up, by map-side counts; the rows themselves are never sorted or moved.
    """
    hashed = df.select(row_hash(seed, key).alias("__h"))
    ends = _hashes_at(hashed, sorted({end - 1 for end in cuts.values() if end > 0}))
    digest, out = row_hash(seed, key), None
    for name, end in cuts.items():
        if end > 0:
            test = digest <= F.lit(ends[end - 1])
            out = F.when(test, name) if out is None else out.when(test, name)
    return df.withColumn(column, F.lit(rest) if out is None else out.otherwise(rest))


def train_test(df: DataFrame, key: str, train_share: float = 0.8, seed: int = 0) -> DataFrame:
    """Exactly ``int(share * n)`` training rows."""
    return exact_split(df, key, {"train": int(train_share * df.count())}, "test", seed)


def train_test_ceil(df: DataFrame, key: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Exactly ``ceil(share * n)`` test rows."""
    n = df.count()
    return exact_split(df, key, {"train": n - math.ceil(test_share * n)}, "test", seed)


def three_way(df: DataFrame, key: str, train_share: float = 0.7, until_val: float = 0.85, seed: int = 0) -> DataFrame:
    n = df.count()
    return exact_split(df, key, {"train": int(n * train_share), "val": int(n * until_val)}, "test", seed)


def sequential_split(df: DataFrame, order: Sequence[str], test_share: float = 0.2, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """The last ``ceil(share * n)`` rows of a unique order are the test rows; rows stay where they are.

    The order columns are dealt into ranges, whose sizes say which range holds the cut; only that one is sorted."""
    n = df.count()
    train = n - math.ceil(test_share * n)
    if train <= 0:
        return df.withColumn("split", F.lit("test"))
    ranges = range_buckets(df.select(*order), [], order, rows_per_bucket, stored=True)  # read again for the sample only
    below = 0
    for number, size in sorted(map(tuple, ranges.groupBy(BUCKET).agg(F.count(F.lit(1))).collect())):
        if below < train <= below + size:
            break
        below += size
    place = F.row_number().over(Window.partitionBy(BUCKET).orderBy(*order))
    last = ranges.filter(F.col(BUCKET) == number).withColumn("__at", place).filter(F.col("__at") == train - below)
    return df.withColumn("split", F.when(at_or_below(order, last), "train").otherwise("test"))


def shuffle_rows(df: DataFrame, key: str, seed: int = 0, partitions: int | None = None) -> DataFrame:
    """Random order by hash inside hash-random partitions; no total order is built."""
    partitions = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = df.withColumn("__h", row_hash(seed, key))
    return hashed.repartition(partitions, "__h").sortWithinPartitions("__h").drop("__h")


def shuffle_rank(df: DataFrame, key: str, seed: int = 0, rank: str = "rank", **sizes) -> DataFrame:
    """Position of each row in the random total order, 1-based."""
    hashed = df.withColumn("__h", row_hash(seed, key))
    return scan(hashed, ["__h", key], rank=rank, **sizes).drop("__h")


def batches(df: DataFrame, key: str, size: int, seed: int | None = None, order: Sequence[str] | None = None, **sizes) -> DataFrame:
    """Batch number per row, 0-based; the last batch may be short. Shuffled if a seed is given."""
    ranked = shuffle_rank(df, key, seed, "__rank", **sizes) if seed is not None else scan(df, order or [key], rank="__rank", **sizes)
    return ranked.withColumn("batch", F.floor((F.col("__rank") - 1) / size)).drop("__rank")
