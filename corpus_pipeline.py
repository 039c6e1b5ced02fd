"""The corpus pipeline: quality rules, near duplicates, repeated passages, benchmark passages, token ids."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from millrace.llm import bpe, decontaminate, neardup, quality, queries, suffixes  # noqa: E402
from millrace.llm.batches import bounded  # noqa: E402
from millrace.session import ship, stage  # noqa: E402


def prepare(spark: SparkSession) -> None:
    ship(spark)
    bounded(spark)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the fertility bands go."""
    prepare(spark)
    return quality.keep_good(docs, queries.fertility())


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    prepare(spark)
    return neardup.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by 200-byte strings that start elsewhere, too, are cut out."""
    prepare(spark)
    return suffixes.without_repeats(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of words that stand in the benchmark are cut out."""
    prepare(spark)
    return decontaminate.remove_hits(docs, queries.table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids."""
    prepare(spark)
    return bpe.with_ids(docs, queries.byte_bpe())


STAGES = [("quality rules", quality_rules), ("MinHash near-dedup", near_duplicates), ("suffix-array dedup", repeated_passages), ("benchmark decontamination", decontaminated), ("BPE encoding and decoding", token_ids)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    for i, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stage(docs, "pipeline")
    return docs
