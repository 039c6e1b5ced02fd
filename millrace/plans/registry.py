"""Registered queries and, where SQL can say the same, the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.plans.fixtures import Inputs, duck_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Inputs], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Inputs(spark, folder))

        QUERIES[name] = run
        if sql:
            CHECKS[name] = duck_sql(sql)
        return fn

    return register
