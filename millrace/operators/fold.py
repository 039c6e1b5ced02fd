"""Ordered state: rating histories and patience scans.

A rating depends on all matches before it, so one pool is one sequence. Its rows are sorted
in the shuffle and streamed through the task batch by batch: memory is the state plus one
batch, however long the sequence; period by period the state is a stored table. Patience
scans only have to find which record improves on which, and follow that way range by range.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.scalar import HOME_ADVANTAGE, START_RATING, goal_multiplier, k_factor, match_result
from millrace.operators.lookup import both_sides
from millrace.operators.ordered import BUCKET, fill_within_key, range_buckets, scan
from millrace.session import stage


def _in_order(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(partitions, *key).sortWithinPartitions(*key, *order)


def rating_history(
    matches: DataFrame,
    pool: str,
    order: Sequence[str],
    home: str = "home",
    away: str = "away",
    home_score: str = "home_score",
    away_score: str = "away_score",
    tournament: str = "tournament",
    start: DataFrame | None = None,
) -> DataFrame:
    """Post-match ratings of both sides, in match order inside each pool.

    A rating belongs to (pool, team). ``start`` (pool, team, elo) continues earlier
    results; other teams begin at 1500. Matches with a missing score are left out.
    """
    scored = matches.filter(F.col(home_score).isNotNull() & F.col(away_score).isNotNull())
    scored = scored.withColumns(
        {
            "k_factor": k_factor(tournament).cast("int"),
            "g_factor": goal_multiplier(F.abs(F.col(home_score) - F.col(away_score))).cast("double"),
            "__won": match_result(home_score, away_score),
        }
    )
    if start is not None:
        first = start.select(pool, "team", F.col("elo").cast("double").alias("__start"))
        scored = both_sides(scored, first, [pool], home, away, "__start")
    else:
        none = F.lit(None).cast("double")
        scored = scored.withColumns({"home___start": none, "away___start": none})
    kept = [pool, *order, home, away, home_score, away_score, "k_factor", "g_factor"]
    scored = _in_order(scored.select(*kept, "__won", "home___start", "away___start"), [pool], order)

    def play(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ratings = object(), {}
        for b in batches:
            cols = [b.column(c).to_pylist() for c in (pool, home, away, "k_factor", "g_factor", "__won", "home___start", "away___start")]
            out_home, out_away = [], []
            for where, h, a, k, g, won, h0, a0 in zip(*cols):
                if where != at:
                    at, ratings = where, {}
                rh = ratings.get(h, START_RATING if h0 is None else h0)
                ra = ratings.get(a, START_RATING if a0 is None else a0)
                move = k * g * (won - 1 / (1 + 10 ** (-(rh - ra + HOME_ADVANTAGE) / 400)))
                ratings[h], ratings[a] = rh + move, ra - move
                out_home.append(rh + move)
                out_away.append(ra - move)
            shown = [b.column(c) for c in kept] + [pa.array(out_home, pa.float64()), pa.array(out_away, pa.float64())]
            yield pa.RecordBatch.from_arrays(shown, names=[*kept, "home_elo", "away_elo"])

    schema = T.StructType([scored.schema[c] for c in kept] + [T.StructField(f"{s}_elo", T.DoubleType()) for s in ("home", "away")])
    return scored.mapInArrow(play, schema)


def _written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to the end."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def rating_periods(matches: DataFrame, pool: str, order: Sequence[str], period: str, folder: str, **names: str) -> DataFrame:
    """The history of ``rating_history``, folded one period after another, with the ratings stored after each.

    ``period`` is a column whose values follow the order (a season, a year); there are few of them, NULL comes first.
    Below ``folder`` a period has its history and the state (pool, team, elo) of all teams so far, with which the next
    one starts. A period whose state is there is not folded again, so a run that was broken off goes on where it
    stopped, and a new period costs its own matches only. To repeat a period, remove its folder and those after it.
    """
    spark, state, parts = matches.sparkSession, None, []
    values = [row[0] for row in matches.select(period).distinct().orderBy(F.asc_nulls_first(period)).collect()]
    for number, value in enumerate(values):
        at = f"{folder}/{number:05d}"
        if not _written(spark, f"{at}/state"):
            part = matches.filter(F.col(period).eqNullSafe(F.lit(value)))
            rating_history(part, pool, order, start=state, **names).write.mode("overwrite").parquet(f"{at}/history")
            sides = {k: names[k] for k in ("home", "away") if k in names}
            new = spark.read.parquet(f"{at}/history").transform(team_rows, pool, order, **sides).groupBy(pool, "team").agg(F.max_by("elo", F.struct(*order)).alias("elo"))
            if state is not None:
                kept = state.join(new, state[pool].eqNullSafe(new[pool]) & state["team"].eqNullSafe(new["team"]), "left_anti")
                new = new.unionByName(kept)
            new.write.mode("overwrite").parquet(f"{at}/state")
        state = spark.read.parquet(f"{at}/state")
        parts.append(f"{at}/history")
    return spark.read.parquet(*parts) if parts else rating_history(matches, pool, order, **names)


def team_rows(history: DataFrame, pool: str, order: Sequence[str], home: str = "home", away: str = "away") -> DataFrame:
    sides = F.array(
        *[F.struct(F.col(t).alias("team"), F.col(f"{r}_elo").alias("elo")) for r, t in (("home", home), ("away", away))]
    )
    return history.select(pool, *order, F.explode(sides).alias("s")).select(pool, *order, "s.team", "s.elo")


def final_ratings(history: DataFrame, pool: str, order: Sequence[str], min_matches: int = 0) -> DataFrame:
    """(pool, team, elo, matches) after each team's last match, teams with more than ``min_matches``."""
    last = (
        team_rows(history, pool, order)
        .groupBy(pool, "team")
        .agg(F.max_by("elo", F.struct(*order)).alias("elo"), F.count(F.lit(1)).alias("matches"))
    )
    return last.filter(F.col("matches") > min_matches)


def teams_in_two_pools(matches: DataFrame, pool: str, home: str, away: str) -> DataFrame:
    """Teams that would need one rating across pools; empty when pools are independent."""
    pairs = matches.select(pool, F.explode(F.array(home, away)).alias("team")).distinct()
    return pairs.groupBy("team").agg(F.count(F.lit(1)).alias("pools")).filter("pools > 1")


def _ranked(log: DataFrame, run: str, order: Sequence[str], loss: Column, sizes: dict) -> DataFrame:
    """Numbered steps with the least loss before each; a NaN loss is missing. Stored."""
    steps = log.withColumn("__loss", F.when(~F.isnan(loss), loss))
    return stage(scan(steps, order, [run], rank="__step", lows={"__low": "__loss"}, **sizes), "steps")


def _same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    return reduce(and_, [left[n].eqNullSafe(right[n]) for n in names])


def _records(ranked: DataFrame, run: str, delta: float, ties: bool, sizes: dict) -> DataFrame:
    """Numbered records of each run, and the number of the first later one that improves on each.

    A step that improves on the best by a non-negative ``delta`` lies below every loss before it, so only running
    minima can matter. Their losses only fall, so the record that improves on one is found by counting how many do
    not: records and the losses to beat stand in one order, and a scan counts the records up to each.
    """
    lower = F.col("__loss") <= F.col("__low") if ties else F.col("__loss") < F.col("__low")
    known = F.col("__loss").isNotNull() if ties else F.col("__loss") < float("inf")
    records = ranked.filter(known & (F.col("__low").isNull() | lower)).select(run, "__step", "__loss")

    def event(value: Column, kind: int, count: int) -> Column:
        return F.struct((-value).alias("__down"), F.lit(kind).alias("__kind"), F.lit(count).alias("__own"))

    both = F.array(event(F.col("__loss"), int(ties), 1), event(F.col("__loss") - delta, int(not ties), 0))
    events = records.select(run, "__step", "__loss", F.explode(both).alias("e")).select(run, "__step", "__loss", "e.*")
    counted = scan(events, ["__down", "__kind", "__step"], [run], rank=None, sums={"__upto": "__own"}, **sizes)
    number = F.max(F.when(F.col("__own") == 1, F.col("__upto")))
    beaten = F.max(F.when(F.col("__own") == 0, F.col("__upto"))) + 1
    nodes = counted.groupBy(run, "__step").agg(F.first("__loss").alias("__loss"), number.alias("__i"), beaten.alias("__next"))
    return nodes.withColumn("__next", F.greatest("__next", F.col("__i") + 1))


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one bucket after another."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        where = batch.column(BUCKET).to_numpy()
        cuts = [0, *(np.flatnonzero(where[1:] != where[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                if held and held[-1].column(BUCKET)[0] != batch.column(BUCKET)[a]:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _segments(table: pa.Table) -> list[tuple[int, int]]:
    """Where the runs of a bucket begin and end: a run's records are numbered from 1 on, only the first in a bucket
    may go on from an earlier one."""
    i = table.column("__i").to_numpy()
    heads = [0, *(np.flatnonzero(i[1:] == 1) + 1).tolist()]
    return list(zip(heads, [*heads[1:], len(i)]))


def _inside(i: np.ndarray, following: np.ndarray) -> np.ndarray:
    """For each record of a segment the last one of it on the way from there, by doubling."""
    place = np.where(following <= i[-1], following - i[0], np.arange(len(i)))
    while True:
        further = place[place]
        if (further == place).all():
            return place
        place = further


def _chain(nodes: DataFrame, run: str, sizes: dict) -> DataFrame:
    """The records on the way from each run's first one along ``__next``, with the steps of the ones before and after.

    Records lie in ranges. A task finds where the way leaves its range from each record of it; these jumps are doubled
    until the records at which the way enters a range are known, in as many rounds as the number of ranges a run
    spans has binary digits; then each range marks its own part. So a run of any length is followed by many tasks.
    """
    held = range_buckets(nodes, [run], ["__i"], **sizes)
    kind = nodes.schema[run]
    longs = [T.StructField(c, T.LongType()) for c in ("__i", "__exit")]

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _buckets(batches):
            a, b = _segments(table)[-1]  # another run follows in the bucket on all others, so they end there
            i, following = (table.column(c).to_numpy()[a:b] for c in ("__i", "__next"))
            whole = table.slice(a, b - a).select([run, "__i"]).append_column("__exit", pa.array(following[_inside(i, following)]))
            yield from whole.to_batches()

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _buckets(batches):
            chosen = np.zeros(table.num_rows, dtype=bool)
            i, following = (table.column(c).to_numpy() for c in ("__i", "__next"))
            entered = table.column("__entry").to_numpy()
            for a, b in _segments(table):
                for at in np.flatnonzero(entered[a:b]).tolist():
                    while at < b - a and not chosen[a + at]:
                        chosen[a + at] = True
                        at = int(following[a + at] - i[a])
            yield from table.filter(pa.array(chosen)).select(names).to_batches()

    def in_buckets(df: DataFrame) -> DataFrame:
        return df.repartition(BUCKET).sortWithinPartitions(BUCKET, run, "__i")

    exits = in_buckets(held.select(BUCKET, run, "__i", "__next")).mapInArrow(leave, T.StructType([kind, *longs]))
    there = held.select(F.col(run).alias("__run"), F.col("__i").alias("__there"))
    jumps = stage(exits.join(there, exits[run].eqNullSafe(there["__run"]) & (F.col("__exit") == F.col("__there")), "left_semi"), "exits")
    entries = reached = stage(held.filter("__i = 1").select(run, "__i"), "entries")
    while not jumps.isEmpty():
        new = stage(reached.join(jumps, _same(reached, jumps, run, "__i")).select(reached[run], jumps["__exit"].alias("__i")), "entries")
        if new.isEmpty():
            break
        entries = reached = reached.unionByName(new)
        on = jumps.select(F.col(run).alias("__run"), F.col("__i").alias("__from"), F.col("__exit").alias("__to"))
        jumps = stage(jumps.join(on, jumps[run].eqNullSafe(on["__run"]) & (F.col("__exit") == F.col("__from"))).select(run, "__i", F.col("__to").alias("__exit")), "exits")
    names = [run, "__step", "__loss", "__i", "__next"]
    flagged = held.join(entries.withColumn("__entry", F.lit(True)), _same(held, entries, run, "__i"), "left")
    flagged = flagged.select(BUCKET, *[held[c] for c in names], F.coalesce("__entry", F.lit(False)).alias("__entry"))
    way = stage(in_buckets(flagged).mapInArrow(mark, held.select(*names).schema), "way")
    later = way.select(F.col(run).alias("__run"), F.col("__i").alias("__at"), F.col("__step").alias("__after"))
    out = way.join(later, way[run].eqNullSafe(later["__run"]) & (F.col("__next") == F.col("__at")), "left").drop("__run", "__at")
    earlier = way.select(F.col(run).alias("__run"), F.col("__next").alias("__at"), F.col("__step").alias("__before"))
    return out.join(earlier, out[run].eqNullSafe(earlier["__run"]) & (F.col("__i") == F.col("__at")), "left").drop("__run", "__at")


def patience_scan(log: DataFrame, run: str, order: Sequence[str], loss: str, patience: int, delta: float, **sizes) -> DataFrame:
    """Best loss so far per run and the step at which ``patience`` bad steps stop it.

    A step improves if ``loss < best - delta``. (run, best_loss, best_step, stop_step, steps);
    ``stop_step`` is NULL if the run ends first; steps after the stop are not looked at.
    """
    ranked = _ranked(log.select(run, *order, loss), run, order, F.col(loss).cast("double"), sizes)
    way = _chain(_records(ranked, run, delta, False, sizes), run, sizes)
    ends = ranked.groupBy(run).agg(F.count(F.lit(1)).alias("__n"))
    joined = ends.join(way.drop("__n").withColumnRenamed(run, "__run"), ends[run].eqNullSafe(F.col("__run")), "left")
    here = F.struct(F.col("__step").alias("step"), F.col("__loss").alias("loss"))
    waited = F.coalesce("__after", F.col("__n") + 1) - 1 - F.col("__step")
    found = joined.groupBy(run, "__n").agg(
        F.min("__step").alias("__first"), F.min(F.when(waited >= patience, here)).alias("__halt"), F.max(F.when(F.col("__step").isNotNull(), here)).alias("__last")
    )
    never = F.coalesce("__first", F.col("__n") + 1) - 1 >= patience
    best = F.when(~never, F.coalesce("__halt", "__last"))
    stop = F.when(never, F.lit(patience).cast("bigint")).otherwise(F.col("__halt.step") + patience)
    return found.select(run, best["loss"].alias("best_loss"), best["step"].alias("best_step"), stop.alias("stop_step"), F.coalesce(stop, "__n").alias("steps"))


def plateau_rate(
    log: DataFrame, run: str, order: Sequence[str], loss: str, rate: float, patience: int, factor: float, delta: float, floor: float,
    mode: str = "min", **sizes,
) -> DataFrame:
    """Learning rate after each step: ``patience`` steps without improvement multiply it by ``factor``.

    A step is bad if ``loss > best - delta``; the count starts anew after a cut. ``mode``
    ``max`` watches a score that should rise. Each step's rate follows from the last
    improvement before it, which is carried forward to it.
    """
    watched = F.col(loss).cast("double") * F.lit(1.0 if mode == "min" else -1.0)
    ranked = _ranked(log, run, order, watched, sizes)
    way = _chain(_records(ranked, run, delta, True, sizes), run, sizes)
    cut = F.floor((F.col("__step") - 1 - F.coalesce("__before", F.lit(0))) / patience)
    better = scan(way.select(run, "__step", cut.alias("__cut")), ["__step"], [run], rank=None, sums={"__cuts": "__cut"}, **sizes)
    rows = ranked.drop("__loss", "__low").withColumn("__row", F.lit(1))
    marks = better.select(run, "__step", F.col("__step").alias("__at"), "__cuts").withColumn("__row", F.lit(0))  # sorts just before its step
    marked = stage(rows.unionByName(marks, allowMissingColumns=True), "improvements")
    filled = fill_within_key(marked, run, ["__step", "__row"], ["__at", "__cuts"], **sizes).filter("__row = 1")
    since = F.when(F.col("__at") <= F.col("__step"), F.col("__at"))  # a later one is not this step's
    waited = F.col("__step") - F.coalesce(since, F.lit(0))
    cuts = F.coalesce(F.when(since.isNotNull(), F.col("__cuts")), F.lit(0)) + F.floor(waited / patience)
    cut_rate = F.greatest(F.lit(float(rate)) * F.pow(F.lit(float(factor)), cuts), F.lit(float(floor)))
    return filled.select(
        *log.columns,
        F.when(cuts == 0, F.lit(float(rate))).otherwise(cut_rate).alias("rate"),
        (waited % patience).cast("bigint").alias("bad_steps"),
    )
