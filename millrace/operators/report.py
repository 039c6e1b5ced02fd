"""Counts, rates, thresholds and top-k reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.lookup import members


def value_counts(df: DataFrame, column: str | Column, name: str = "value") -> DataFrame:
    """(value, n), missing values ignored, most frequent first."""
    c = F.col(column) if isinstance(column, str) else column
    counted = df.select(c.alias(name)).filter(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), name)


def role_rows(matches: DataFrame, home: str = "home", away: str = "away", home_score: str = "home_score", away_score: str = "away_score", keep: Sequence[str] = ()) -> DataFrame:
    """Two rows a match: each side with the goals it scored and conceded."""
    sides = F.array(
        *[
            F.struct(F.lit(r).alias("role"), F.col(t).alias("team"), F.col(s).alias("scored"), F.col(c).alias("conceded"))
            for r, t, s, c in (("home", home, home_score, away_score), ("away", away, away_score, home_score))
        ]
    )
    return matches.select(*keep, F.explode(sides).alias("side")).select(*keep, "side.*")


def role_counts(matches: DataFrame, key: Sequence[str] = (), home: str = "home", away: str = "away") -> DataFrame:
    """How often each entity occurs in either role."""
    teams = matches.select(*key, F.explode(F.array(home, away)).alias("team"))
    return teams.groupBy(*key, "team").agg(F.count(F.lit(1)).alias("n"))


def mean_group_count(df: DataFrame, column: str | Column) -> DataFrame:
    c = F.col(column) if isinstance(column, str) else column
    counts = df.select(c.alias("v")).filter("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.avg("n").alias("mean_count"))


def frequent(counts: DataFrame, threshold: int, n: str = "n") -> DataFrame:
    """Groups with more than ``threshold`` rows."""
    return counts.filter(F.col(n) > threshold)


def clean_sheets(roles: DataFrame, key: Sequence[str]) -> DataFrame:
    """Share of matches without a goal conceded, in percent."""
    return roles.groupBy(*key).agg(
        F.coalesce(F.lit(100.0) * F.avg((F.col("conceded") == 0).cast("double")), F.lit(0.0)).alias("clean_pct")
    )


def win_rates(roles: DataFrame, key: Sequence[str]) -> DataFrame:
    """Home and away win rate in percent; a role never played is 0."""
    won = (F.col("scored") > F.col("conceded")).cast("double")
    rate = {r: F.lit(100.0) * F.avg(F.when(F.col("role") == r, won)) for r in ("home", "away")}
    return roles.groupBy(*key).agg(*[F.coalesce(e, F.lit(0.0)).alias(f"{r}_win_pct") for r, e in rate.items()])


def top(df: DataFrame, by: str, n: int, ties: Sequence[str]) -> DataFrame:
    return df.orderBy(F.desc(by), *ties).limit(n)


def only_top(df: DataFrame, best: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keep the rows of a computed top set."""
    return members(df, best, on)


def epoch_means(log: DataFrame, key: Sequence[str], value: str, size: str) -> DataFrame:
    """Both ways to average batch metrics: weighted by batch size, and plain."""
    return log.groupBy(*key).agg(
        (F.sum(F.col(value) * F.col(size)) / F.sum(size)).alias("weighted_mean"),
        F.avg(value).alias("plain_mean"),
    )
