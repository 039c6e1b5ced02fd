"""Ratings and patience scans against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import scalar
from millrace.operators import fold, lookup, report
from millrace.operators.ordered import BUCKET, range_buckets

NAMES = ["FIFA World Cup", "olympic games", "Copa América", "CONCACAF Nations League", "Gold Cup qualification", "friendly", "King's Cup"]
KS = dict(zip(NAMES, [60, 60, 40, 30, 30, 15, 25]))


def loop(matches, start=None):
    elo, out = dict(start or {}), {}
    for m in sorted(matches, key=lambda m: (m["day"], m["id"])):
        h, a = (m["pool"], m["home"]), (m["pool"], m["away"])
        rh, ra = elo.get(h, 1500), elo.get(a, 1500)
        gap = abs(m["hs"] - m["as_"])
        g = 1.0 if gap <= 1 else 1.5 if gap == 2 else (11 + gap) / 8
        won = 1.0 if m["hs"] > m["as_"] else 0.0 if m["hs"] < m["as_"] else 0.5
        move = KS[m["name"]] * g * (won - 1 / (1 + 10 ** (-(rh - ra + 100) / 400)))
        elo[h], elo[a] = rh + move, ra - move
        out[m["id"]] = (elo[h], elo[a])
    return elo, out


def made(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        pool = "big" if i % 3 else rng.choice(["x", "y"])
        h, a = rng.sample("abcdefgh", 2)
        rows.append(dict(id=i, day=f"20{rng.randrange(10, 20)}-01-0{rng.randrange(1, 9)}", pool=pool, home=h, away=a, hs=rng.choice([0, 1, 2, 3, 7]), as_=rng.choice([0, 1, 2]), name=rng.choice(NAMES)))
    return rows


def rate(df, **kw):
    return fold.rating_history(df, "pool", ["day", "id"], home_score="hs", away_score="as_", tournament="name", **kw)


@pytest.mark.parametrize("partitions", [1, 7])
def test_ratings_equal_a_loop(spark, partitions):
    rows = made(900)
    df = spark.createDataFrame(rows).repartition(partitions)
    elo, per_match = loop(rows)
    got = rate(df)
    for r in got.collect():
        assert (r.home_elo, r.away_elo) == pytest.approx(per_match[r.id], abs=1e-9)
    final = fold.final_ratings(got, "pool", ["day", "id"]).collect()
    assert {(r.pool, r.team): pytest.approx(r.elo, abs=1e-9) for r in final} == elo
    for pool in {r.pool for r in final}:
        mine = [r.elo for r in final if r.pool == pool]
        assert sum(mine) == pytest.approx(1500 * len(mine))


def test_ratings_continue_from_a_saved_table(spark):
    rows = made(300, seed=2)
    cut = sorted(rows, key=lambda m: (m["day"], m["id"]))[150]["day"]
    df = spark.createDataFrame(rows)
    before, after = df.filter(F.col("day") < cut), df.filter(F.col("day") >= cut)
    start = fold.final_ratings(rate(before), "pool", ["day", "id"])
    whole = {r.id: r.home_elo for r in rate(df).collect()}
    for r in rate(after, start=start).collect():
        assert r.home_elo == pytest.approx(whole[r.id], abs=1e-9)


def test_missing_scores_are_left_out(spark):
    rows = made(40, seed=3)
    df = spark.createDataFrame(rows).withColumn("hs", F.when(F.col("id") != 7, F.col("hs")))
    _, want = loop([m for m in rows if m["id"] != 7])
    assert {r.id: pytest.approx(r.home_elo) for r in rate(df).collect()} == {i: v[0] for i, v in want.items()}


def test_team_in_two_pools_is_found(spark):
    df = spark.createDataFrame([("p", "a", "b"), ("q", "b", "c")], "pool string, home string, away string")
    assert [r.team for r in fold.teams_in_two_pools(df, "pool", "home", "away").collect()] == ["b"]


def test_thresholds_and_rates(spark):
    df = spark.createDataFrame([("a", "b", 1, 0), ("a", "c", 0, 0), ("b", "a", 2, 2)], "home string, away string, home_score int, away_score int")
    counts = report.role_counts(df)
    assert {r.team: r.n for r in report.frequent(counts, 2).collect()} == {"a": 3}
    roles = report.role_rows(df)
    wins = {r.team: (r.home_win_pct, r.away_win_pct) for r in report.win_rates(roles, ["team"]).collect()}
    assert wins == {"a": (50.0, 0.0), "b": (0.0, 0.0), "c": (0.0, 0.0)}
    clean = {r.team: round(r.clean_pct, 3) for r in report.clean_sheets(roles, ["team"]).collect()}
    assert clean == {"a": 66.667, "b": 0.0, "c": 100.0}


def test_scalar_cases(spark):
    df = spark.createDataFrame([(0, 2.5, "Friendly"), (1, 3.5, "x qualification"), (2, -0.5, "EAFF Championship"), (3, 0.5, "uefa euro"), (7, 1.5, "CONMEBOL–UEFA cup of champions")], "gap int, v double, name string")
    rows = df.select(scalar.goal_multiplier("gap").alias("g"), scalar.round_half_even("v").alias("r"), scalar.k_factor("name").alias("k")).collect()
    assert [r.g for r in rows] == [1.0, 1.0, 1.5, 1.75, 2.25]
    assert [r.r for r in rows] == [2.0, 4.0, 0.0, 0.0, 2.0]
    assert [r.k for r in rows] == [15, 30, 40, 40, 40]


def test_replacement_is_single_pass_and_last_wins(spark):
    dim = spark.createDataFrame([("A", "X", 0), ("A", "B", 1), ("B", "C", 2)], "former string, current string, ord int")
    df = spark.createDataFrame([("A", "B", 1), ("Z", None, 2)], "h string, a string, n int")
    got = lookup.replace_values(df, lookup.last_wins(dim, "former", "ord", "current"), "former", "current")
    assert [tuple(r) for r in got.orderBy("n").collect()] == [("B", "C", 1), ("Z", None, 2)]


def test_large_lookup_side_is_not_broadcast(spark):
    dim = spark.range(2_000_000).selectExpr("id as k", "concat('value ', repeat(cast(id as string), 20)) as v")
    for out in (lookup.lookup(spark.range(100).withColumnRenamed("id", "k"), dim, ["k"], ["v"]), lookup.members(spark.range(100).withColumnRenamed("id", "k"), dim, ["k"])):
        assert "ResolvedHint" not in out._jdf.queryExecution().analyzed().toString()
        assert "rightHint" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_repeated_keys_do_not_multiply_rows(spark):
    dim = spark.createDataFrame([("a", "A1", 1), ("a", "A2", 2), ("b", None, 1)], "k string, v string, ord int")
    df = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "k string")
    assert [tuple(r) for r in lookup.lookup(df, dim, ["k"], ["v"], "ord").orderBy("k").collect()] == [(None, None), ("a", "A2"), ("b", None), ("c", None)]
    assert [r.k for r in lookup.replace_values(df, dim, "k", "v", order="ord").orderBy("k").collect()] == [None, "A2", "b", "c"]
    ratings = spark.createDataFrame([(1, "x", 5.0), (1, "x", 7.0)], "pool int, team string, elo double")
    matches = spark.createDataFrame([(1, "x", "y")], "pool int, home string, away string")
    assert [(r.home_elo, r.away_elo) for r in lookup.both_sides(matches, ratings, ["pool"], "home", "away", "elo").collect()] == [(7.0, None)]


def patience(losses, p, delta):
    best, at, bad = math.inf, None, 0
    for i, x in enumerate(losses, 1):
        if x is not None and x < best - delta:
            best, at, bad = x, i, 0
        else:
            bad += 1
            if bad >= p:
                return best if at else None, at, i, i
    return best if at else None, at, None, len(losses)


def plateau(losses, rate, p, factor, delta, floor):
    best, bad, out = math.inf, 0, []
    for x in losses:
        if x is None or x > best - delta:
            bad += 1
            if bad >= p:
                rate, bad = max(rate * factor, floor), 0
        else:
            best, bad = x, 0
        out.append((rate, bad))
    return out


@pytest.fixture(scope="module")
def runs():
    rng = random.Random(8)
    logs = {k: [round(rng.uniform(0, 3), 1) for _ in range(rng.randrange(1, 60))] for k in range(60)}
    logs[100] = [5.0 - i * 0.01 for i in range(3000)]  # one long falling run
    logs[101] = [1.0, 0.5, 0.5, 0.5, 0.5]  # exactly best - delta is no improvement
    logs[102] = [None, None, 2.0, None]
    logs[103] = [1.0] * 4  # patience reached on the last step
    return logs


@pytest.mark.parametrize("p, delta, size", [(3, 0.5, 10**6), (1, 0.0, 500), (10, 0.2, 150)])
def test_patience(spark, runs, p, delta, size):
    df = spark.createDataFrame([(k, i, x) for k, xs in runs.items() for i, x in enumerate(xs)], "run bigint, t bigint, loss double")
    got = {r.run: tuple(r)[1:] for r in fold.patience_scan(df.repartition(5), "run", ["t"], "loss", p, delta, rows_per_bucket=size).collect()}
    assert got == {k: patience(xs, p, delta) for k, xs in runs.items()}


@pytest.mark.parametrize("p, delta, size", [(3, 0.5, 10**6), (1, 0.0, 500), (4, 0.1, 150)])
def test_plateau(spark, runs, p, delta, size):
    df = spark.createDataFrame([(k, i, x) for k, xs in runs.items() for i, x in enumerate(xs)], "run bigint, t bigint, loss double")
    got = fold.plateau_rate(df.repartition(5), "run", ["t"], "loss", 0.1, p, 0.5, delta, 1e-4, rows_per_bucket=size).collect()
    for k, xs in runs.items():
        mine = [(r.rate, r.bad_steps) for r in sorted((r for r in got if r.run == k), key=lambda r: r.t)]
        want = plateau(xs, 0.1, p, 0.5, delta, 1e-4)
        assert [b for _, b in mine] == [b for _, b in want]
        assert [a for a, _ in mine] == pytest.approx([a for a, _ in want])


@pytest.mark.parametrize("delta, p", [(0.0, 3), (0.7, 200)])
def test_one_long_run_over_many_ranges(spark, delta, p):
    """A loss that always falls, with bumps, spread over some forty ranges of records."""
    rng = random.Random(3)
    losses = [1000 - i * 0.01 + rng.choice((0, 0, 0.05)) for i in range(20_000)]
    rows = [(None, i, x) for i, x in enumerate(losses)] + [("b", i, x) for i, x in enumerate(losses[:700])] + [("c", 0, math.inf), ("c", 1, math.nan)]
    df = spark.createDataFrame(rows, "run string, t bigint, loss double").repartition(6)
    got = {r.run: tuple(r)[1:] for r in fold.patience_scan(df, "run", ["t"], "loss", p, delta, rows_per_bucket=500).collect()}
    assert got == {None: patience(losses, p, delta), "b": patience(losses[:700], p, delta), "c": patience([math.inf, None], p, delta)}
    got = fold.plateau_rate(df, "run", ["t"], "loss", 0.1, 3, 0.99, delta, 1e-4, rows_per_bucket=500).collect()
    mine = [(r.rate, r.bad_steps) for r in sorted((r for r in got if r.run is None), key=lambda r: r.t)]
    want = plateau(losses, 0.1, 3, 0.99, delta, 1e-4)
    assert [b for _, b in mine] == [b for _, b in want]
    assert [a for a, _ in mine] == pytest.approx([a for a, _ in want])


def test_a_long_run_is_followed_by_many_tasks(spark):
    """The way through a run without a pause is marked range by range, no range holds more than its share."""
    log = spark.range(0, 60_000, 1, 8).select(F.lit(1).alias("run"), F.col("id").alias("t"), (-F.col("id")).cast("double").alias("loss"))
    sizes = {"rows_per_bucket": 2000}
    nodes = fold._records(fold._ranked(log, "run", ["t"], F.col("loss"), sizes), "run", 1.5, False, sizes)
    way = fold._chain(nodes, "run", sizes)
    assert [r[0] for r in way.orderBy("__step").select("__step").collect()] == list(range(1, 60_001, 2))
    shares = range_buckets(nodes, ["run"], ["__i"], **sizes).groupBy(BUCKET).count().collect()
    assert len(shares) >= 25 and max(r["count"] for r in shares) < 6000


def test_ratings_by_period(spark, tmp_path):
    rows = sorted(made(300), key=lambda m: (m["day"], m["id"]))
    df = spark.createDataFrame([m | {"season": None if k < 40 else k // 100} for k, m in enumerate(rows)])
    names = {"home_score": "hs", "away_score": "as_", "tournament": "name"}

    def folded(matches, folder):
        return fold.rating_periods(matches, "pool", ["day", "id"], "season", str(tmp_path / folder), **names)

    _, once = loop(rows)
    assert folded(df.filter("season is null or season < 2"), "r").count() == 200
    states = tmp_path / "r" / "00000" / "state"
    before = {p.name: p.stat().st_mtime_ns for p in states.iterdir()}
    (tmp_path / "r" / "00001" / "state" / "_SUCCESS").unlink()  # broken off in the second period
    got = {r.id: (r.home_elo, r.away_elo) for r in folded(df, "r").collect()}
    assert got == {i: pytest.approx(v, abs=1e-9) for i, v in once.items()}
    assert before == {p.name: p.stat().st_mtime_ns for p in states.iterdir()}  # not folded again
    assert folded(df.filter("id < 0"), "none").count() == 0
