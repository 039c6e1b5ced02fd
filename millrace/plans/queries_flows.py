"""Whole flows as registered queries, with SQL that walks the same way."""

from __future__ import annotations

from functools import reduce

import pyspark.sql.functions as F
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression

from millrace.operators import inspect, sample
from millrace.plans import flows
from millrace.plans import queries_score  # noqa: F401  (registers the queries whose SQL is used here)
from millrace.plans.queries_ordered import ELO_SQL, THRESHOLD
from millrace.plans.queries_prep import big, r
from millrace.plans.registry import CHECKS, query
from millrace.session import fresh_path
from millrace.sources import tables

CODES = {"_": 4, "Bad": 0, "Standard": 1, "Good": 2}
SCALED = ("amount_s", "age", "income", "mix", "history")


def sql_scaled(c: str) -> str:
    return f"round(({c} - avg({c}) filter (not test) over ()) / nullif(stddev_pop({c}) filter (not test) over (), 0), 6) + 0.0 as {c}"


@query(
    "flow_prepared_tables",
    r"""with a as (select id, customer_id, id % 3 = 0 as test, category, loans, cast(age as double) as age, income,
      case when regexp_full_match(amount_s, '\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*') then try_cast(amount_s as double) end as amount_s,
      cast(case mix when '_' then 4 when 'Bad' then 0 when 'Standard' then 1 when 'Good' then 2 end as double) as mix,
      cast(coalesce(try_cast(nullif(regexp_extract(history, '(\d+)\sYears', 1), '') as int), 0) * 12 + coalesce(try_cast(nullif(regexp_extract(history, '(\d+)\sMonths', 1), '') as int), 0) as double) as history from v_dirty),
    own as (select test, median(amount_s) as m1, median(age) as m2, median(income) as m3 from a group by test),
    b as (select id, customer_id, test, category, loans, mix, history, coalesce(amount_s, m1) as amount_s, coalesce(age, m2) as age, coalesce(income, m3) as income from a join own using (test)),
    iqr as (select quantile_cont(income, 0.25) as q1, quantile_cont(income, 0.75) as q3 from b where not test),
    c as (select b.* exclude (age, income), case when age between 0 and 99 then age end as age, case when income between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) then income end as income from b, iqr),
    d as (select * exclude (age, income), coalesce(last_value(age ignore nulls) over p, first_value(age ignore nulls) over n) as age, coalesce(last_value(income ignore nulls) over p, first_value(income ignore nulls) over n) as income from c
      window p as (partition by test, customer_id order by id rows between unbounded preceding and current row), n as (partition by test, customer_id order by id rows between current row and unbounded following)),
    rest as (select test, median(age) as m2, median(income) as m3 from d group by test),
    e as (select d.* exclude (age, income), coalesce(age, m2) as age, coalesce(income, m3) as income from d join rest using (test) where mix is not null),
    levels as (select min(category) as first from a where not test),
    known as (select distinct unnest(string_split(loans, ', ')) as token from a where not test and loans is not null)
    select id, case when test then 'test' else 'train' end as split, """
    + ", ".join(map(sql_scaled, SCALED))
    + """, (select count(*) from levels where category <> first and category in (select category from a where not test)) as flags,
      (select count(distinct token) from known where list_contains(string_split(loans, ', '), token)) as tokens from e""",
)
def prepared(t):
    """The dirty table, a third of it as test part, cleaned and scaled; indicators are shown by their number."""
    df = t.v_dirty.drop("is_error").withColumn("age", F.col("age").cast("double"))
    train, test = df.filter("id % 3 > 0"), df.filter("id % 3 = 0")
    spec = flows.TableSpec(
        key="customer_id", order=["id"], numeric_text=["amount_s"], categories=["category"], token_list="loans",
        codes={"mix": CODES}, durations=["history"], bounds={"age": (0, 99)}, fences={"income": 1.5}, fill=["age", "income"],
    )
    parts = tables.presplit(**dict(zip(("train", "test"), flows.prepare_tables(train, test, spec))))
    shown = [c for c in parts.columns if c not in ("id", "customer_id", "split", *SCALED)]
    count = lambda names: reduce(lambda x, y: x + y, [F.col(f"`{c}`").cast("bigint") for c in names], F.lit(0).cast("bigint"))
    flags, tokens = [c for c in shown if c.startswith("category_")], [c for c in shown if not c.startswith("category_")]
    return parts.select("id", "split", *[r(c).alias(c) for c in SCALED], count(flags).alias("flags"), count(tokens).alias("tokens"))


@query(
    "flow_match_reports",
    ELO_SQL
    + f""", best as (select pool, team, elo, matches from last where matches > {THRESHOLD} order by elo desc, pool, team limit 20),
    roles as (select pool, 'home' as role, home as team, home_score as scored, away_score as conceded from v_matches union all select pool, 'away', away, away_score, home_score from v_matches),
    mine as (select roles.* from roles join best using (pool, team)),
    b as (select *, year(dt) as year, greatest(home_elo, away_elo) as top from hist),
    y as (select year, pool, case when home_elo > away_elo then home else away end as team, top from b qualify row_number() over (partition by year order by top desc, dt, match_id) = 1)
    select 'top' as part, pool, team, round_even(elo, 0) as x, matches::double as y from best
    union all select 'yearly', pool, team, round(top, 6), year::double from y
    union all select 'clean_sheets', pool, team, round(100 * avg(case when conceded = 0 then 1.0 else 0.0 end), 6), null from mine group by pool, team
    union all select 'win_rates', pool, team, round(coalesce(100 * avg(case when scored > conceded then 1.0 else 0.0 end) filter (role = 'home'), 0), 6),
      round(coalesce(100 * avg(case when scored > conceded then 1.0 else 0.0 end) filter (role = 'away'), 0), 6) from mine group by pool, team""",
)
def match_flow(t):
    """Top teams, yearly leaders, clean sheets and win rates of the top teams from one rating history."""
    found = flows.match_reports(t.v_matches, "pool", ["dt", "match_id"], "dt", min_matches=THRESHOLD)
    none = F.lit(None).cast("double")
    shown = {
        "top": (F.col("elo"), F.col("matches").cast("double")),
        "yearly": (r("top"), F.col("period").cast("double")),
        "clean_sheets": (r("clean_pct"), none),
        "win_rates": (r("home_win_pct"), r("away_win_pct")),
    }
    parts = [found[name].select(F.lit(name).alias("part"), "pool", big("team").alias("team"), x.cast("double").alias("x"), y.alias("y")) for name, (x, y) in shown.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query(
    "flow_classifier_reports",
    f"""select 'report' as part, name, precision as x, recall as y from ({CHECKS["i3_report"]})
    union all select 'confusion', concat(label, '-', pred), n::double, null from ({CHECKS["i2_confusion"]})""",
)
def classifier_flow(t):
    """The class report and the grid that a scored table gives in one flow."""
    found = flows.classifier_reports(t.v_scored, "y", "logits")
    parts = found["report"].select(F.lit("report").alias("part"), "name", r("precision", 8).alias("x"), r("recall", 8).alias("y"))
    cells = found["confusion"].select(F.lit("confusion").alias("part"), F.concat_ws("-", "label", "pred").alias("name"), F.col("n").cast("double").alias("x"), F.lit(None).cast("double").alias("y"))
    return parts.unionByName(cells)


@query(
    "a6_load_model",
    """with c as (select regr_slope(y, l_quantity) as b, regr_intercept(y, l_quantity) as a from v_regress)
    select l_orderkey, l_linenumber::bigint as l_linenumber, round(a + b * l_quantity, 4) as prediction from v_regress, c""",
)
def load_model(t):
    """A model that was fitted, written to the shared folder and read again."""
    parts = [VectorAssembler(inputCols=["l_quantity"], outputCol="features"), LinearRegression(featuresCol="features", labelCol="y", solver="normal")]
    path = fresh_path(t.spark, "model")
    tables.save_model(Pipeline(stages=parts).fit(t.v_regress), path)
    return tables.load_model(path).transform(t.v_regress).select("l_orderkey", big("l_linenumber").alias("l_linenumber"), r("prediction", 4).alias("prediction"))


@query(
    "b6_types_table",
    """select cid::bigint as position, name as "column", case type when 'VARCHAR' then 'string' when 'TIMESTAMP' then 'timestamp_ntz' else lower(type) end as type from pragma_table_info('orders')""",
)
def types(t):
    return inspect.types_table(t.orders)


@query("e5_shuffled_rows", "select event_id from events")
def shuffled(t):
    """All rows in hash order inside hash-random partitions."""
    return sample.shuffle_rows(t.events.select("event_id"), "event_id", seed=3)
