"""Tables: CSV in, parquet out, pre-split reads and generated regression data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.scalar import hash_normal
from millrace.operators.learn import Layers, layers_of, weights_table
from millrace.session import stage


def scan_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Header CSV with a stated schema; no inference pass. Dirty columns are read as text."""
    return spark.read.schema(schema).csv(path, header=True, mode="PERMISSIVE")


def split_csv(spark: SparkSession, path: str, schema: str, header: bool = True, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """The rows that fit the schema, and (file, block, line) of those that do not: too few or too many cells, or a cell
    that its type cannot hold.

    The files are parsed once and stored; both tables read that copy. ``block`` is the byte at which the part of the
    file begins that a task read, so a line is found there without reading the file from its start. ``multi_line``
    allows line breaks in quoted cells; a file is then one part. A quote in a cell is doubled. Empty cells are NULL.
    """
    options = {"header": header, "multiLine": multi_line, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__rejected", "escape": '"'}
    rows = spark.read.schema(f"{schema}, __rejected string").options(**options).csv(path)
    places = {"__file": F.col("_metadata.file_path"), "__block": F.col("_metadata.file_block_start")}
    held = stage(rows.withColumns(places), "csv-rows")
    line = F.rtrim(F.col("__rejected"), F.lit("\r\n"))
    rejected = held.filter("__rejected is not null").select(F.col("__file").alias("file"), F.col("__block").alias("block"), line.alias("line"))
    return held.filter("__rejected is null").drop("__rejected", *places), rejected


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True)


def presplit(**parts: DataFrame) -> DataFrame:
    """Stack the given parts of one dataset and name each row's part in ``split``."""
    out = None
    for name, df in parts.items():
        df = df.withColumn("split", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


def regression_data(rows: DataFrame, key: str, weights: Sequence[float], noise: float = 0.1, seed: int = 42) -> DataFrame:
    """Append ``feature_1..k`` (standard normal) and ``target`` = features . weights + noise.

    Values depend on (seed, key) alone, so a recomputed partition gives the same rows.
    For a table of n rows pass ``spark.range(n)`` and key ``id``.
    """
    names = [f"feature_{j}" for j in range(1, len(weights) + 1)]
    drawn = rows.withColumns({c: hash_normal(seed, key, F.lit(c)) for c in names} | {"__e": hash_normal(seed, key, F.lit("noise"))})
    target = F.col("__e") * F.lit(float(noise))
    for c, w in zip(names, weights):
        target = target + F.col(c) * F.lit(float(w))
    return drawn.withColumn("target", target).drop("__e")


def write_result(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write a result table and return it read back.

    Partitioned writes are rebalanced first: one folder's rows meet in few tasks, and a
    folder that holds most rows is split over several by adaptive execution.
    """
    if partition_by:
        df.hint("rebalance", *partition_by).write.partitionBy(*partition_by).parquet(path)
    else:
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def save_weights(df: DataFrame, layers: Layers, path: str) -> None:
    weights_table(df, layers).write.parquet(path)


def load_weights(spark: SparkSession, path: str) -> Layers:
    return layers_of(spark.read.parquet(path))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
