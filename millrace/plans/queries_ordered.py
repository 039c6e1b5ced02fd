"""Registered queries: windows, ratings, scans, reports, joins, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import scalar, vectors
from millrace.operators import fold, learn, lookup, ordered, report
from millrace.plans.queries_prep import big, r
from millrace.plans.registry import query
from millrace.session import fresh_path, stage

# --- sorted windows and targets ------------------------------------------------------


@query(
    "f1_sliding_window",
    """with w as (select t, count(*) over p as n, sum(open) over p as open_sum, sum(high) over p as high_sum, sum(volume) over p as volume_sum,
      first_value(low) over p as first_low, last_value(low) over p as last_low, count(*) over () as total
      from v_series window p as (order by t rows between 60 preceding and 1 preceding))
    select t, n, round(open_sum, 4) as open_sum, round(high_sum, 4) as high_sum, round(volume_sum, 4) as volume_sum, first_low, last_low
    from w where n = 60 and t < total - 2""",
)
def f1(t):
    rows = ordered.sliding_windows(t.v_series, ["t"], ["open", "high", "low", "volume"], ["open", "close"])

    def summed(name):
        return r(F.aggregate("window", F.lit(0.0), lambda a, x: a + x[name]), 4).alias(f"{name}_sum")

    return rows.select(
        "t", big(F.size("window")).alias("n"), summed("open"), summed("high"), summed("volume"),
        F.col("window")[0]["low"].alias("first_low"), F.col("window")[59]["low"].alias("last_low"),
    )


@query(
    "f2_horizon_target",
    """with w as (select t, row_number() over (order by t) as rn, lead(open, 2) over (order by t) as next_open, lead(close, 2) over (order by t) as next_close from v_series)
    select t, next_open, next_close from w where rn > 60 and next_open is not null""",
)
def f2(t):
    rows = ordered.sliding_windows(t.v_series, ["t"], ["open"], ["open", "close"], index="t")
    return rows.select("t", F.col("target.open").alias("next_open"), F.col("target.close").alias("next_close"))


@query(
    "f3_date_sort",
    "select match_id, strftime(dt, '%Y-%m-%d') as day, row_number() over (order by dt, match_id) as place from v_matches",
)
def f3(t):
    placed = ordered.scan(t.v_matches.select("match_id", "dt"), ["dt", "match_id"], rank="place")
    return ordered.sort_rows(placed, ["dt", "match_id"]).select("match_id", F.date_format("dt", "yyyy-MM-dd").alias("day"), "place")


# --- ratings -------------------------------------------------------------------------

K_SQL = """case when lower(tournament) = 'fifa world cup' then 60
      when lower(tournament) = 'copa américa' then 40
      when lower(tournament) like '%qualification%' then 30 when lower(tournament) = 'friendly' then 15 else 25 end"""
G_SQL = "case when abs(home_score - away_score) <= 1 then 1.0::double when abs(home_score - away_score) = 2 then 1.5::double else (11 + abs(home_score - away_score)) / 8.0::double end"
S_SQL = "case when home_score > away_score then 1.0::double when home_score < away_score then 0.0::double else 0.5::double end"

# One step per match of a pool; the state is the list of the pool's 25 ratings.
ELO_SQL = f"""with recursive m as materialized (select match_id, dt, pool, home, away, home_score, away_score, {K_SQL} as k, {G_SQL} as g, {S_SQL} as s,
      row_number() over (partition by pool order by dt, match_id) as rn from v_matches),
    e as (
      select pool, 0::bigint as rn, list_transform(range(25), lambda x: 1500.0::double) as ratings, 0.0::double as home_elo, 0.0::double as away_elo from (select distinct pool from m)
      union all
      select q.pool, q.rn, list_transform(q.ratings, lambda x, i: case when i = q.home + 1 then x + q.mv when i = q.away + 1 then x - q.mv else x end),
        q.ratings[q.home + 1] + q.mv, q.ratings[q.away + 1] - q.mv
      from (select e.pool, m.rn, e.ratings, m.home, m.away,
          m.k * m.g * (m.s - 1 / (1 + power(10.0::double, -(e.ratings[m.home + 1] - e.ratings[m.away + 1] + 100) / 400))) as mv
        from e join m on m.pool = e.pool and m.rn = e.rn + 1) q),
    hist as materialized (select m.match_id, m.dt, m.pool, m.home, m.away, m.home_score, m.away_score, m.k, m.g, e.home_elo, e.away_elo from e join m on m.pool = e.pool and m.rn = e.rn),
    sides as (select pool, dt, match_id, home as team, home_elo as elo from hist union all select pool, dt, match_id, away, away_elo from hist),
    last as (select pool, team, arg_max(elo, (dt, match_id)) as elo, count(*) as matches from sides group by pool, team)"""
THRESHOLD = 20


def history(t):
    return fold.rating_history(t.v_matches, "pool", ["dt", "match_id"])


@query(
    "f4_rating_history",
    ELO_SQL + """ select match_id, pool, home, away, home_score, away_score, cast(k as bigint) as k_factor, g as g_factor,
    round(home_elo, 6) as home_elo, round(away_elo, 6) as away_elo from hist""",
)
def f4(t):
    h = history(t)
    return h.select(
        "match_id", "pool", "home", "away", "home_score", "away_score", big("k_factor").alias("k_factor"), "g_factor",
        r("home_elo").alias("home_elo"), r("away_elo").alias("away_elo"),
    )


@query(
    "f4_rating_periods",
    ELO_SQL + """ select match_id, pool, home, away, home_score, away_score, cast(k as bigint) as k_factor, g as g_factor,
    round(home_elo, 6) as home_elo, round(away_elo, 6) as away_elo from hist""",
)
def f4_periods(t):
    """The same ratings folded in two periods; the second starts with the stored state of the first."""
    matches = t.v_matches.withColumn("period", F.when(F.year("dt") < 1995, 1).otherwise(2))
    h = fold.rating_periods(matches, "pool", ["dt", "match_id"], "period", fresh_path(t.spark, "ratings"))
    return h.select(
        "match_id", "pool", "home", "away", "home_score", "away_score", big("k_factor").alias("k_factor"), "g_factor",
        r("home_elo").alias("home_elo"), r("away_elo").alias("away_elo"),
    )


@query(
    "f5_team_timeline",
    ELO_SQL + """, pick as (select pool, team from last qualify row_number() over (partition by pool order by elo desc, team) <= 2)
    select s.pool, s.team, s.match_id, strftime(s.dt, '%Y-%m-%d') as day, round(s.elo, 6) as elo from sides s join pick using (pool, team)""",
)
def f5(t):
    h = stage(history(t), "history")  # read twice, folded once
    best = fold.final_ratings(h, "pool", ["dt", "match_id"])
    ranked = ordered.scan(best.withColumn("down", -F.col("elo")), ["down", "team"], ["pool"])
    rows = ordered.timeline(h, ranked.filter("rank <= 2"), "home", "away", {"elo": ("home_elo", "away_elo")}, key=["pool"])
    return rows.select("pool", "team", "match_id", F.date_format("dt", "yyyy-MM-dd").alias("day"), r("elo").alias("elo"))


@query(
    "f6_yearly_leaders",
    ELO_SQL + """, b as (select *, year(dt) as year, greatest(home_elo, away_elo) as top from hist)
    select cast(year as bigint) as year, pool, case when home_elo > away_elo then home else away end as team, round_even(top, 0) as elo from b
    qualify row_number() over (partition by year order by top desc, dt, match_id) = 1""",
)
def f6(t):
    h = history(t).withColumn("top", F.greatest("home_elo", "away_elo"))
    leader = F.when(F.col("home_elo") > F.col("away_elo"), F.col("home")).otherwise(F.col("away")).alias("team")
    best = ordered.best_per_period(h, scalar.year_of("dt"), "top", [scalar.moment("dt"), F.col("match_id")], [F.col("pool"), leader, F.col("top")])
    return best.select(big("period").alias("year"), "pool", "team", scalar.round_half_even("top").alias("elo"))



@query(
    "f7_patience_scan",
    """with l as (select run_id, cast(epoch as bigint) as epoch, loss from v_runlog),
    s as (select run_id, epoch, loss as best, epoch as best_step, 0::bigint as bad from l where epoch = 1
      union all
      select s.run_id, l.epoch, case when l.loss < s.best - 0.5 then l.loss else s.best end,
        case when l.loss < s.best - 0.5 then l.epoch else s.best_step end, case when l.loss < s.best - 0.5 then 0 else s.bad + 1 end
      from s join l on l.run_id = s.run_id and l.epoch = s.epoch + 1 where s.bad < 10)
    select run_id, arg_max(best, epoch) as best_loss, arg_max(best_step, epoch) as best_step,
      max(case when bad >= 10 then epoch end) as stop_step, max(epoch) as steps from s group by run_id""",
)
def f7(t):
    return fold.patience_scan(t.v_runlog.select("run_id", "epoch", "loss"), "run_id", ["epoch"], "loss", patience=10, delta=0.5)


@query(
    "f8_plateau_rate",
    """with l as (select run_id, cast(epoch as bigint) as epoch, loss from v_runlog),
    s as (select run_id, epoch, loss as best, 0::bigint as bad, 0.1::double as rate from l where epoch = 1
      union all
      select run_id, epoch, case when worse then best else loss end, case when worse and bad + 1 < 5 then bad + 1 else 0 end,
        case when worse and bad + 1 >= 5 then greatest(rate * 0.3::double, 0.00001::double) else rate end
      from (select s.run_id, l.epoch, l.loss, s.best, s.bad, s.rate, l.loss > s.best - 0.001 as worse
        from s join l on l.run_id = s.run_id and l.epoch = s.epoch + 1))
    select run_id, epoch, round(rate, 10) as rate, bad as bad_steps from s""",
)
def f8(t):
    rows = fold.plateau_rate(t.v_runlog.select("run_id", "epoch", "loss"), "run_id", ["epoch"], "loss", rate=0.1, patience=5, factor=0.3, delta=1e-3, floor=1e-5)
    return rows.select("run_id", big("epoch").alias("epoch"), r("rate", 10).alias("rate"), "bad_steps")


def sql_windows(window: int, more: str = "") -> str:
    """Rows with a whole window before and a target two rows ahead; the last fifth is the test part."""
    return f"""with s as (select *, {more} row_number() over (order by t) as i, lag(open) over (order by t) as before, lead(open, 2) over (order by t) as y_open, lead(close, 2) over (order by t) as y_close from v_series),
    w as (select *, row_number() over (order by t) as k, count(*) over () as n from s where i > {window} and y_open is not null),
    p as (select *, case when k <= n - ceil(0.2 * n) then 'train' else 'test' end as split from w)"""


@query(
    "f9_windowed_forecast",
    sql_windows(60)
    + """, l as (select split, unnest(['open', 'close']) as target, unnest([y_open, y_close]) as y from p),
    m as (select target, avg(y) as m from l where split = 'train' group by target)
    select target, split, count(*) as n, round(sqrt(avg((y - m) * (y - m))), 6) as mean_rmse, true as fits from l join m using (target) group by target, split""",
)
def f9(t):
    """Rows and yardstick are exact; on the rows it was fitted on, the model must not be worse than their mean."""
    out = learn.forecast(t.v_series, ["t"], ["open", "high", "low", "volume"], ["open", "close"])
    fits = (F.col("split") == "test") | (F.col("rmse") <= F.col("mean_rmse") * (1 + 1e-9))
    return out.select("target", "split", "n", r("mean_rmse").alias("mean_rmse"), fits.alias("fits"))


@query(
    "f9_one_feature",
    sql_windows(1)
    + """, c as (select regr_slope(y_close, before) as b, regr_intercept(y_close, before) as a from p where split = 'train')
    select 'close' as target, split, count(*) as n, round(sqrt(avg(power(y_close - a - b * before, 2))), 6) as rmse from p, c group by split""",
)
def f9_one(t):
    out = learn.forecast(t.v_series, ["t"], ["open"], ["close"], window=1, penalty=0.0)
    return out.select("target", "split", "n", r("rmse").alias("rmse"))


def sql_least_squares(width: int, goals: int) -> str:
    """Elimination on the moments of the training rows of ``p``, whose ``z`` holds features and then targets; result in ``solved``."""
    every = width + goals
    steps = [
        f"""e0 as materialized (select x.i, y.j, sum((z[x.i] - a[x.i]) * (z[y.j] - a[y.j])) as v from p, mean, range(1, {width + 1}) x(i), range(1, {every + 1}) y(j) where split = 'train' group by x.i, y.j)"""
    ]
    for k in range(1, width + 1):
        steps.append(
            f"""e{k} as materialized (select c.i, c.j, case when c.i = {k} then c.v / diag.v else c.v - own.v * top.v / diag.v end as v from e{k - 1} c
      join e{k - 1} top on top.i = {k} and top.j = c.j join e{k - 1} own on own.j = {k} and own.i = c.i join e{k - 1} diag on diag.i = {k} and diag.j = {k})"""
        )
    means = ", ".join(f"avg(z[{i}])" for i in range(1, every + 1))
    return f"mean as materialized (select [{means}] as a from p where split = 'train'), " + ", ".join(steps) + f", solved as (select j - {width} as goal, list(v order by i) as w from e{width} where j > {width} group by j)"


LAGS = [f"lag({c}, {n}) over (order by t)" for n in (2, 1) for c in ("open", "high", "low", "volume")]


@query(
    "f9_four_features",
    sql_windows(2, f"[{', '.join([*LAGS, *(f'lead({c}, 2) over (order by t)' for c in ('open', 'close'))])}] as z,")
    + ", " + sql_least_squares(8, 2) + """,
    l as (select split, unnest(['open', 'close']) as target, unnest([1, 2]) as goal, z, unnest([y_open, y_close]) as y from p),
    f as (select target, split, y - a[8 + l.goal] as m, list_sum(list_transform(range(1, 9), lambda i: (z[i] - a[i]) * w[i])) as fitted from l join solved on solved.goal = l.goal, mean)
    select target, split, count(*) as n, round(sqrt(avg((m - fitted) * (m - fitted))), 6) as rmse, round(sqrt(avg(m * m)), 6) as mean_rmse from f group by target, split""",
)
def f9_four(t):
    """The errors themselves, of the model with all features on windows of two rows, next to the normal equations."""
    out = learn.forecast(t.v_series, ["t"], ["open", "high", "low", "volume"], ["open", "close"], window=2, penalty=0.0)
    return out.select("target", "split", "n", r("rmse").alias("rmse"), r("mean_rmse").alias("mean_rmse"))


# --- reports -------------------------------------------------------------------------


@query("g1_value_counts", "select event_type as value, count(*) as n from events where event_type is not null group by 1")
def g1(t):
    return report.value_counts(t.events, "event_type")


@query(
    "g2_role_counts",
    "select pool, team, count(*) as n from (select pool, home as team from v_matches union all select pool, away from v_matches) group by all",
)
def g2(t):
    return report.role_counts(t.v_matches, ["pool"])


@query("g3_mean_group_count", "select round(avg(n), 6) as mean_count from (select user_id, count(*) as n from events group by 1)")
def g3(t):
    return report.mean_group_count(t.events, "user_id").select(r("mean_count").alias("mean_count"))


@query(
    "g4_frequent_teams",
    """with c as (select pool, team, count(*) as n from (select pool, home as team from v_matches union all select pool, away from v_matches) group by all)
    select pool, team, n from c where n > 24""",
)
def g4(t):
    return report.frequent(report.role_counts(t.v_matches, ["pool"]), 24)


SIDES_SQL = """with s as (select pool, 'home' as role, home as team, home_score as scored, away_score as conceded from v_matches
    union all select pool, 'away', away, away_score, home_score from v_matches)"""


@query("g5_clean_sheets", SIDES_SQL + " select pool, team, round(100 * avg(case when conceded = 0 then 1.0 else 0.0 end), 6) as clean_pct from s group by all")
def g5(t):
    return report.clean_sheets(report.role_rows(t.v_matches, keep=["pool"]), ["pool", "team"]).withColumn("clean_pct", r("clean_pct"))


@query(
    "g6_win_rates",
    SIDES_SQL
    + """ select pool, team, round(coalesce(100 * avg(case when scored > conceded then 1.0 else 0.0 end) filter (where role = 'home'), 0), 6) as home_win_pct,
    round(coalesce(100 * avg(case when scored > conceded then 1.0 else 0.0 end) filter (where role = 'away'), 0), 6) as away_win_pct from s group by all""",
)
def g6(t):
    rates = report.win_rates(report.role_rows(t.v_matches, keep=["pool"]), ["pool", "team"])
    return rates.withColumns({c: r(c) for c in ("home_win_pct", "away_win_pct")})


@query(
    "g7_top_ratings",
    ELO_SQL + f""" select pool, team, round_even(elo, 0) as elo, matches from last where matches > {THRESHOLD} order by round_even(elo, 0) desc, pool, team limit 20""",
)
def g7(t):
    """Top 20 of the teams with more than 20 matches, by rounded rating."""
    final = fold.final_ratings(history(t), "pool", ["dt", "match_id"], min_matches=THRESHOLD)
    return report.top(final.withColumn("elo", scalar.round_half_even("elo")), "elo", 20, ["pool", "team"])


@query("g8_top_hours", "select hour(ts) as hour, count(*) as n from events group by 1 order by n desc, hour limit 5")
def g8(t):
    return report.value_counts(t.events, big(F.hour("ts")), "hour").limit(5)


@query(
    "g9_exact_quantiles",
    " union all ".join(
        f"""select '{c}' as "column", {q}::double as q, round(quantile_cont({c}, {q}), 6) as value from lineitem"""
        for c in ("l_extendedprice", "l_quantity") for q in (0.25, 0.5, 0.75, 0.99)
    ),
)
def g9(t):
    from millrace.operators.quantiles import quantile_table

    qs = [0.25, 0.5, 0.75, 0.99]
    return quantile_table(t.lineitem, {"l_extendedprice": qs, "l_quantity": qs}).withColumn("value", r("value"))


@query(
    "g10_top_set_report",
    ELO_SQL
    + """, top as (select pool, team from last order by elo desc, pool, team limit 20),
    r as (select pool, home as team, away_score as conceded from hist union all select pool, away, home_score from hist)
    select r.pool, r.team, round(100 * avg(case when conceded = 0 then 1.0 else 0.0 end), 6) as clean_pct from r join top using (pool, team) group by all""",
)
def g10(t):
    final = fold.final_ratings(history(t), "pool", ["dt", "match_id"])
    best = report.top(final, "elo", 20, ["pool", "team"])
    rows = report.only_top(report.role_rows(t.v_matches, keep=["pool"]), best, ["pool", "team"])
    return report.clean_sheets(rows, ["pool", "team"]).withColumn("clean_pct", r("clean_pct"))


@query(
    "g11_epoch_means",
    """select run_id, cast((epoch - 1) // 10 as bigint) as epoch, round(sum(loss * n) / sum(n), 6) as weighted_mean, round(avg(loss), 6) as plain_mean from v_runlog group by all""",
)
def g11(t):
    rows = t.v_runlog.withColumn("epoch", big(F.floor((F.col("epoch") - 1) / 10)))
    return report.epoch_means(rows, ["run_id", "epoch"], "loss", "n").withColumns({c: r(c) for c in ("weighted_mean", "plain_mean")})


# --- joins and set operations --------------------------------------------------------


@query("j1_lookup", "select cast(n_nationkey as bigint) as n_nationkey, n_name, current from nation left join v_alias on n_name = former")
def j1(t):
    dim = t.v_alias.withColumnRenamed("former", "n_name")
    return lookup.lookup(t.nation.select("n_nationkey", "n_name"), dim, ["n_name"], ["current"]).withColumn("n_nationkey", big("n_nationkey"))



@query(
    "j2_statistics_on_rows",
    "select l_orderkey, round(l_quantity - (select avg(l_quantity) from lineitem), 6) + 0.0 as over_mean from lineitem",
)
def j2(t):
    row = lookup.one_row(t.lineitem.agg(F.avg("l_quantity").alias("mean")))
    return t.lineitem.select("l_orderkey", r(F.col("l_quantity") - row["mean"]).alias("over_mean"))


@query(
    "j3_expectation",
    ELO_SQL
    + """ select m.match_id, round(1 / (1 + power(10.0::double, -(h.elo - a.elo + 100) / 400)), 6) as expected_home
    from m join last h on h.pool = m.pool and h.team = m.home join last a on a.pool = m.pool and a.team = m.away""",
)
def j3(t):
    final = fold.final_ratings(history(t), "pool", ["dt", "match_id"])
    rows = lookup.both_sides(t.v_matches.select("match_id", "pool", "home", "away"), final, ["pool"], "home", "away", "elo")
    return rows.select("match_id", r(scalar.expected_score("home_elo", "away_elo", home=True)).alias("expected_home"))


@query(
    "j4_membership",
    """with c as (select pool, home as team, count(*) as n from v_matches group by all having count(*) > 12)
    select match_id from v_matches where (pool, home) in (select (pool, team) from c)""",
)
def j4(t):
    busy = t.v_matches.groupBy("pool", "home").agg(F.count(F.lit(1)).alias("n")).filter("n > 12")
    return lookup.members(t.v_matches, busy, ["pool", "home"]).select("match_id")


@query(
    "j4_filtered_membership",
    """with c as (select o_orderkey from orders where o_totalprice > 300000) select l_orderkey, l_linenumber, l_partkey from lineitem where l_orderkey in (select o_orderkey from c)""",
)
def j4_filtered(t):
    dear = t.orders.filter("o_totalprice > 300000").select(F.col("o_orderkey").alias("l_orderkey"))
    return lookup.members_filtered(t.lineitem, dear, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("j5_stack_columns", "select match_id, pool, home as team from v_matches union all select match_id, pool, away from v_matches")
def j5(t):
    return t.v_matches.select("match_id", "pool", F.explode(F.array("home", "away")).alias("team"))


@query(
    "j6_label_union",
    """with p as (select cast(y as bigint) as y, cast(list_position(logits, list_max(logits)) - 1 as bigint) as pred from v_scored)
    select y as label from p union select pred from p""",
)
def j6(t):
    return lookup.label_union(t.v_scored.select("y", vectors.argmax("logits").alias("pred")), "y", "pred")


# --- scalar and vector functions -----------------------------------------------------


@query(
    "h1_expected_score",
    "select match_id, round(1 / (1 + power(10.0::double, -((1500.0 + 10 * home - (1500 + 7 * away)) + 100) / 400)), 6) as expected from v_matches",
)
def h1(t):
    own, other = F.lit(1500.0) + F.col("home") * 10, F.lit(1500.0) + F.col("away") * 7
    return t.v_matches.select("match_id", r(scalar.expected_score(own, other, home=True)).alias("expected"))


@query("h2_goal_multiplier", f"select match_id, {G_SQL} as g from v_matches")
def h2(t):
    return t.v_matches.select("match_id", scalar.goal_multiplier(F.abs(F.col("home_score") - F.col("away_score"))).alias("g"))


@query("h3_k_factor", f"select match_id, cast({K_SQL} as bigint) as k from v_matches")
def h3(t):
    return t.v_matches.select("match_id", big(scalar.k_factor("tournament")).alias("k"))


@query(
    "h4_rating_update",
    f"select match_id, round(1500 + ({K_SQL}) * ({G_SQL}) * (({S_SQL}) - 1 / (1 + power(10.0::double, -100.0 / 400))), 6) as elo from v_matches",
)
def h4(t):
    base, gap = F.lit(1500.0), F.abs(F.col("home_score") - F.col("away_score"))
    elo = scalar.updated_rating(
        base, scalar.match_result("home_score", "away_score"), scalar.expected_score(base, base, True), scalar.k_factor("tournament"), scalar.goal_multiplier(gap)
    )
    return t.v_matches.select("match_id", r(elo).alias("elo"))


@query("h5_match_result", f"select match_id, {S_SQL} as result from v_matches")
def h5(t):
    return t.v_matches.select("match_id", scalar.match_result("home_score", "away_score").alias("result"))


@query("h6_year_of", "select o_orderkey, cast(year(cast(strftime(o_orderdate, '%Y-%m-%d') as date)) as bigint) as year from orders")
def h6(t):
    return t.orders.select("o_orderkey", big(scalar.year_of(F.date_format("o_orderdate", "yyyy-MM-dd"))).alias("year"))


@query("h7_round_half_even", "select match_id, round_even((home + 10 * home_score + away) / 2.0::double, 0) as v from v_matches")
def h7(t):
    return t.v_matches.select("match_id", scalar.round_half_even((F.col("home") + F.col("home_score") * 10 + F.col("away")) / F.lit(2.0)).alias("v"))


@query(
    "h8_text_functions",
    r"""select doc_id, regexp_extract(text, '(\d+)\s[a-z]+', 1) as number, contains(lower(text), 'the') as has_the,
      len(string_split(text, ', ')) as parts, ends_with(text, '.') as full_stop, md5(lower(text)) as lowered from documents""",
)
def h8(t):
    text = F.col("text")
    return t.documents.select(
        "doc_id",
        F.regexp_extract(text, r"(\d+)\s[a-z]+", 1).alias("number"),
        F.lower(text).contains("the").alias("has_the"),
        big(F.size(F.split(text, r"\Q, \E"))).alias("parts"),
        text.endswith(".").alias("full_stop"),
        F.md5(F.lower(text)).alias("lowered"),
    )


SOFTMAX_SQL = """with e as (select row_id, y, logits, list_transform(logits, lambda x: exp(x - list_max(logits))) as ex from v_scored),
    p as (select row_id, y, logits, list_transform(ex, lambda x: x / list_sum(ex)) as probs from e)"""


@query("h9_softmax", SOFTMAX_SQL + " select row_id, i - 1 as class, round(probs[i], 8) as p from p, range(1, 11) t(i)")
def h9(t):
    rows = t.v_scored.select("row_id", F.posexplode(vectors.softmax("logits")).alias("class", "p"))
    return rows.select("row_id", big("class").alias("class"), r("p", 8).alias("p"))


@query("h10_argmax", "select row_id, cast(list_position(logits, list_max(logits)) - 1 as bigint) as pred from v_scored")
def h10(t):
    return t.v_scored.select("row_id", big(vectors.argmax("logits")).alias("pred"))


@query(
    "h11_activations",
    """select row_id, i - 1 as pos, greatest(0.0, px[i] - 40) as relu, round(case when px[i] - 40 > 0 then px[i] - 40 else exp(px[i] - 40) - 1 end, 8) + 0.0 as elu
    from v_image, range(1, 65) t(i)""",
)
def h11(t):
    x = F.transform("px", lambda v: v - F.lit(40.0))
    rows = t.v_image.select("row_id", F.posexplode(F.arrays_zip(vectors.relu(x).alias("relu"), vectors.elu(x).alias("elu"))).alias("pos", "a"))
    return rows.select("row_id", big("pos").alias("pos"), F.col("a.relu").alias("relu"), r("a.elu", 8).alias("elu"))
