"""Rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.ranks import placed

SCALE = 1 << 60


def score(key: Column, shard: int, weight: float = 1.0) -> Column:
    """The draw of a shard for a key: -weight / ln(u) with u hashed from both alone, so a record meets
    the same draws whatever other shards there are. The largest draw wins with a chance in proportion
    to the weight, and a new shard can only take records for which its own draw is the largest. ``u`` stays
    below 1, where the logarithm is 0, also for the highest hashes."""
    hashed = F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(shard)))), 1, 15), 16, 10).cast("long")
    return F.lit(-float(weight)) / F.log(uniform(hashed))


def uniform(hashed: Column) -> Column:
    """60 bits of a hash as a number above 0 and below 1."""
    return F.least((hashed.cast("double") + F.lit(0.5)) / F.lit(float(SCALE)), F.lit(1 - 2.0**-53))


def shard_rows(records: DataFrame, key: str, order: Sequence[str], weights: Sequence[float], more: Sequence[float] = (1.0,)) -> DataFrame:
    """Adds ``shard``, ``slot`` and ``grown_shard`` to every record.

    ``shard`` follows from the key and the weights alone; ``grown_shard`` is the one with shards of the
    weights ``more`` added. ``slot`` counts a shard's records from 0 without gaps, by key and then
    ``order``; rows equal in all of these share out neighbouring slots. A null key counts as an empty one;
    empty input gives no rows. Columns named like the new ones are replaced.
    """
    records = records.drop("shard", "slot", "grown_shard")
    held = F.coalesce(F.col(key).cast("string"), F.lit(""))
    draw = lambda first, some: [F.struct(score(held, first + i, w).alias("s"), F.lit(first + i).alias("i")) for i, w in enumerate(some)]
    low = F.struct(F.lit(float("-inf")).alias("s"), F.lit(-1).alias("i"))
    first = F.greatest(low, *draw(0, weights))
    rows = records.select("*", first.alias("shard")).select("*", F.greatest(low, F.col("shard"), *draw(len(weights), more)).alias("grown_shard"))
    rows = rows.select(*records.columns, F.col("shard.i").alias("shard"), F.col("grown_shard.i").alias("grown_shard"))
    return placed(rows, "shard", [key, *order], "slot").select(*records.columns, "shard", "slot", "grown_shard")


def measured(documents: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 16, of a null text 16) and the CRC-32 of the text (null: of no bytes)."""
    held = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return documents.select("doc_id", (F.octet_length(held) + F.lit(16)).cast("long").alias("size"), F.crc32(held).alias("text_crc32"))
