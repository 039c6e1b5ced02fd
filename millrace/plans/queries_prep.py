"""Registered queries: sources, inspection, cleaning, encoding, splits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.scalar import last_token
from millrace.functions.vectors import argmax, one_hot_label
from millrace.operators import clean, encode, evaluate, inspect, learn, quantiles, sample
from millrace.operators.lookup import last_wins, replace_cells, replace_values
from millrace.operators.ordered import scan
from millrace.plans.registry import query
from millrace.session import fresh_path, stage
from millrace.sources import folders, tables


def big(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def r(c: str | Column, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


# --- sources and sinks ---------------------------------------------------------------


@query(
    "a1_scan_csv",
    """select o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') as day, o_orderpriority from orders""",
)
def a1(t):
    path = fresh_path(t.spark, "orders-csv")
    tables.write_csv(t.orders, path)
    df = tables.scan_csv(t.spark, path, t.orders.schema)
    return df.select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderpriority"
    )


@query(
    "a1_rejected_lines",
    """with o as (select o_orderkey as k, cast(o_totalprice as varchar) as p, o_orderkey % 40 as m from orders)
    select 'good' as kind, k as orderkey, cast(p as double) as price, case when m = 9 then concat('two', chr(10), 'lines, ', '"', 'quoted', '"') else 'plain' end as note, null::varchar as line from o where m not in (3, 5, 7)
    union all select 'rejected', null, null, null, case m when 3 then concat(k, ',', p) when 5 then concat(k, ',n/a,plain') else concat(k, ',', p, ',plain,more') end from o where m in (3, 5, 7)""",
)
def a1_rejected(t):
    """Orders as lines of text, some with a cell too few or too many, a wrong number, or a cell of two lines; read back as rows and rejected lines."""
    k, p, m = F.col("o_orderkey").cast("string"), F.col("o_totalprice").cast("string"), F.col("o_orderkey") % 40
    line = (
        F.when(m == 3, F.concat(k, F.lit(","), p)).when(m == 5, F.concat(k, F.lit(",n/a,plain"))).when(m == 7, F.concat(k, F.lit(","), p, F.lit(",plain,more")))
        .when(m == 9, F.concat(k, F.lit(","), p, F.lit(',"two\nlines, ""quoted"""'))).otherwise(F.concat(k, F.lit(","), p, F.lit(",plain")))
    )
    path = fresh_path(t.spark, "lines")
    t.orders.select(line.alias("value")).write.text(path)
    good, rejected = tables.split_csv(t.spark, path, "orderkey bigint, price double, note string", header=False, multi_line=True)
    return good.withColumn("kind", F.lit("good")).unionByName(rejected.select("line", F.lit("rejected").alias("kind")), allowMissingColumns=True)


@query(
    "a2_folder_labels",
    """with f as (select file_id, regexp_extract(path, '([^/]+)/[^/]+$', 1) as class_name from v_files)
    select file_id, class_name, dense_rank() over (order by class_name) - 1 as label from f""",
)
def a2(t):
    files = t.v_files.withColumn("class_name", folders.parent_class("path"))
    return folders.with_labels(files).select("file_id", "class_name", big("label").alias("label"))


@query(
    "a2_scan_image_folder",
    """with i as (select row_id, label, cast(row_id % 2 as bigint) as grey, list_transform(px, lambda x: cast(x as bigint)) as px from v_image),
    f as (select concat('part', cast(row_id % 3 as bigint), '/class_', label, '/image_', row_id, '.png') as file, concat('class_', label) as class_name, row_id % 50 = 7 as broken,
      case when grey = 1 then 8 else 4 end as height, case when grey = 1 then 8 else 5 end as width, case when grey = 1 then 1 else 3 end as channels,
      case when grey = 1 then list_sum(px) else list_sum(px[1:60]) end as pixel_sum, case when grey = 1 then px[1] else px[3] end as first_red from i)
    select file, class_name, dense_rank() over (order by class_name) - 1 as label, broken, case when not broken then cast(height as bigint) end as height,
      case when not broken then cast(width as bigint) end as width, case when not broken then cast(channels as bigint) end as channels,
      case when not broken then cast(pixel_sum as bigint) end as pixel_sum, case when not broken then first_red end as first_red from f""",
)
def a2_scan(t):
    """Grey and colour images and broken files are written to nested folders, then listed, decoded and labelled."""
    grey = F.col("row_id") % 2 == 1
    px = F.transform("px", lambda x: F.lpad(F.hex(x.cast("bigint")), 2, "0"))
    image = t.v_image.select(
        F.format_string("part%d/class_%d/image_%d.png", F.col("row_id") % 3, "label", "row_id").alias("file"),
        (F.col("row_id") % 50 == 7).alias("broken"),
        *[F.when(grey, a).otherwise(b).alias(c) for c, a, b in (("height", 8, 4), ("width", 8, 5), ("channels", 1, 3))],
        F.unhex(F.array_join(F.when(grey, px).otherwise(F.slice(px, 1, 60)), "")).alias("data"),
    )
    files = folders.encode_png(image).withColumn("content", F.when(~F.col("broken"), F.col("content")).otherwise(F.encode(F.lit("no image"), "utf-8")))
    root = fresh_path(t.spark, "images")
    folders.write_files(files, root)
    found = folders.scan_with_broken(t.spark, root)
    byte = F.transform(F.split(F.rtrim(F.regexp_replace(F.hex("data"), "(..)", "$1 ")), " "), lambda x: F.conv(x, 16, 10).cast("bigint"))
    shown = found.withColumn("bytes", byte)
    return shown.select(
        F.regexp_extract("path", "(part[^/]+/[^/]+/[^/]+)$", 1).alias("file"), "class_name", big("label").alias("label"), "broken",
        *[big(c).alias(c) for c in ("height", "width", "channels")],
        F.aggregate("bytes", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("pixel_sum"),
        F.when(F.col("channels") == 1, F.get("bytes", F.lit(0))).otherwise(F.get("bytes", F.lit(2))).alias("first_red"),
    )


@query(
    "a3_route_by_filename",
    """select file_id, path, regexp_extract(regexp_extract(path, '([^/]+)$', 1), '^(.*)_[^_]*$', 1) as class_name
    from v_files where path like '%.jpg'""",
)
def a3(t):
    routed = folders.route_by_filename(t.v_files, "path").select("file_id", "path", "class_name")
    done = tables.write_result(routed, fresh_path(t.spark, "routed"), ["class_name"])
    return done.select("file_id", "path", F.col("class_name").cast("string").alias("class_name"))


@query(
    "a4_scan_presplit",
    """select row_id, cast(y as bigint) as y, case when row_id % 2 = 0 then 'train' else 'test' end as split from v_scored""",
)
def a4(t):
    rows = t.v_scored.select("row_id", big("y").alias("y"))
    return tables.presplit(train=rows.filter("row_id % 2 = 0"), test=rows.filter("row_id % 2 = 1"))


WEIGHTS = [12.5, -3.0, 40.25, 7.0, -21.5]


def sql_uniform(text: str) -> str:
    """DuckDB form of the hashed uniform over a ':'-joined text expression."""
    return f"(('0x' || substr(md5({text}), 1, 8))::bigint / 4294967296.0::double)"


def sql_normal(seed: int, key: str, name: str) -> str:
    u, v = (sql_uniform(f"'{seed}:' || {key} || ':{name}:{s}'") for s in "ab")
    return f"(sqrt(-2.0::double * ln(1.0::double - {u})) * cos(6.283185307179586::double * {v}))"


def sql_features(seed: int = 42) -> str:
    cols = ", ".join(f"{sql_normal(seed, 'o_orderkey', f'feature_{j}')} as feature_{j}" for j in range(1, len(WEIGHTS) + 1))
    return f"select o_orderkey, {cols}, {sql_normal(seed, 'o_orderkey', 'noise')} as noise from orders"


@query(
    "a5_regression_data",
    f"""with d as ({sql_features()})
    select o_orderkey, {", ".join(f"round(feature_{j}, 6) + 0.0 as feature_{j}" for j in range(1, 6))},
      round(0.1 * noise + {" + ".join(f"({w}) * feature_{j}" for j, w in enumerate(WEIGHTS, 1))}, 5) + 0.0 as target from d""",
)
def a5(t):
    df = tables.regression_data(t.orders.select("o_orderkey"), "o_orderkey", WEIGHTS)
    return df.select("o_orderkey", *[r(f"feature_{j}").alias(f"feature_{j}") for j in range(1, 6)], r("target", 5).alias("target"))


CLASS_MEAN_LOGITS = """with w as (select cast(label as bigint) as class, i - 1 as pos, avg(cast(embedding[i] as double)) as value
      from embeddings, range(1, 65) t(i) group by all),
    x as (select vec_id as row_id, i - 1 as pos, cast(embedding[i] as double) as x from embeddings, range(1, 65) t(i)),
    s as (select row_id, class, sum(x * value) as logit from x join w using (pos) group by all)"""


@query("a6_save_load_model", CLASS_MEAN_LOGITS + " select row_id, class, round(logit, 6) + 0.0 as logit from s")
def a6(t):
    layers = learn.layers_of(learn.class_mean_table(t.embeddings, "embedding", "label"))
    path = fresh_path(t.spark, "weights")
    tables.save_weights(t.embeddings, layers, path)
    scored = learn.score(t.embeddings.select("vec_id", "embedding"), "embedding", tables.load_weights(t.spark, path))
    return scored.select(F.col("vec_id").alias("row_id"), F.posexplode("logits").alias("class", "logit")).select(
        "row_id", big("class").alias("class"), r("logit").alias("logit")
    )


@query(
    "a7_write_result",
    """select event_type, count(*) as n, round(avg(value), 6) as mean_value from events group by event_type""",
)
def a7(t):
    out = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), r(F.avg("value")).alias("mean_value"))
    return tables.write_result(out, fresh_path(t.spark, "result"))


# --- projection, filter, inspection --------------------------------------------------


@query("b1_drop_columns", "select o_orderkey, o_custkey, o_orderpriority from orders")
def b1(t):
    return t.orders.drop("o_orderstatus", "o_totalprice", "o_orderdate")


@query(
    "b2_columns_by_type",
    """select l_orderkey, l_partkey, l_suppkey, cast(l_linenumber as bigint) as l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax from lineitem""",
)
def b2(t):
    return t.lineitem.select(*inspect.columns_of_type(t.lineitem, "number")).withColumn("l_linenumber", big("l_linenumber"))


@query(
    "b3_row_filter",
    """select match_id, pool, home, away, home_score, away_score from v_matches
    where (home = 3 and away_score = 0) or (away = 3 and home_score = 0) or home_score > away_score + 2""",
)
def b3(t):
    m = t.v_matches
    keep = ((m.home == 3) & (m.away_score == 0)) | ((m.away == 3) & (m.home_score == 0)) | (m.home_score > m.away_score + 2)
    return m.filter(keep).select("match_id", "pool", "home", "away", "home_score", "away_score")


DIRTY = "id customer_id category is_error amount_s age income mix history loans".split()


@query(
    "b4_null_profile",
    " union all ".join(
        f"""select '{c}' as "column", count(*) - count({c}) as nulls, count(*) > count({c}) as any_null from v_dirty""" for c in DIRTY
    ),
)
def b4(t):
    return inspect.null_profile(t.v_dirty)


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "b5_describe",
    " union all ".join(
        f"""select '{c}' as "column", count({c}) as n, round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std, min({c}) as min,
        round(quantile_cont({c}, 0.25), 4) as q1, round(quantile_cont({c}, 0.5), 4) as median, round(quantile_cont({c}, 0.75), 4) as q3, max({c}) as max from lineitem"""
        for c in NUMBERS
    ),
)
def b5(t):
    out = inspect.describe(t.lineitem, NUMBERS)
    return out.withColumns({c: r(c, 4) for c in ("mean", "std", "q1", "median", "q3")})


@query("b6_shape", "select count(*) as rows, cast(6 as bigint) as columns from orders")
def b6_shape(t):
    return inspect.shape(t.orders)


@query("b6_head", "select o_orderkey, o_custkey, o_totalprice, o_orderpriority from orders order by o_orderkey limit 5")
def b6_head(t):
    return inspect.head(t.orders, ["o_orderkey"], 5).select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")


@query("b7_distinct_values", "select distinct c_mktsegment from customer")
def b7(t):
    return inspect.distinct_values(t.customer, "c_mktsegment")


@query("b8_row_max", "select match_id, greatest(home_score, away_score) as best from v_matches")
def b8(t):
    return t.v_matches.select("match_id", F.greatest("home_score", "away_score").alias("best"))


@query("b9_conditional_column", "select match_id, case when home_score > away_score then home else away end as leader from v_matches")
def b9(t):
    return t.v_matches.select("match_id", F.when(F.col("home_score") > F.col("away_score"), F.col("home")).otherwise(F.col("away")).alias("leader"))


@query(
    "b10_align_columns",
    """select id, cast(age as bigint) as age, 0.0::double as income from v_dirty where id % 2 = 0
    union all select id, cast(0 as bigint) as age, income from v_dirty where id % 2 = 1""",
)
def b10(t):
    left = t.v_dirty.filter("id % 2 = 0").select("id", big("age").alias("age"))
    right = t.v_dirty.filter("id % 2 = 1").select("id", "income")
    left, right = inspect.align(left, right)
    return left.unionByName(right).select("id", big("age").alias("age"), F.col("income").cast("double").alias("income"))


@query("b11_sorted_columns", "select o_custkey, o_orderkey, o_orderpriority, o_orderstatus, o_totalprice from orders")
def b11(t):
    return inspect.sort_columns(t.orders.drop("o_orderdate"))


@query(
    "b12_drop_missing",
    """select id, category, amount_s, cast(age as bigint) as age, income, history, loans from v_dirty
    where id is not null and customer_id is not null and category is not null and amount_s is not null and age is not null
      and income is not null and mix is not null and history is not null and loans is not null""",
)
def b12(t):
    kept = inspect.drop_missing(t.v_dirty)
    return kept.select("id", "category", "amount_s", big("age").alias("age"), "income", "history", "loans")


@query("b13_min_side", "select file_id, path from v_files where least(width, height) >= 200")
def b13(t):
    return t.v_files.filter(inspect.min_side("width", "height", 200)).select("file_id", "path")


@query("b14_exact_size", "select file_id, path from v_files where width = 300 and height = 162")
def b14(t):
    return t.v_files.filter(inspect.exact_size("width", "height", 300, 162)).select("file_id", "path")


@query("b15_leading_rows", "select t, open, close from v_series order by t limit 100")
def b15(t):
    return inspect.head(t.v_series, ["t"], 100).select("t", "open", "close")


# --- cleaning and imputation ---------------------------------------------------------

SQL_NUMBER = r"""case when regexp_full_match(amount_s, '\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*') then try_cast(amount_s as double) end"""


@query("c1_to_numeric", f"select id, {SQL_NUMBER} as amount from v_dirty")
def c1(t):
    return t.v_dirty.select("id", clean.to_numeric("amount_s").alias("amount"))


@query(
    "c2_median_fill",
    f"""with d as (select id, {SQL_NUMBER} as amount, cast(age as double) as age, income from v_dirty),
    m as (select median(amount) as ma, median(age) as mg, median(income) as mi from d)
    select id, round(coalesce(amount, ma), 6) as amount, coalesce(age, mg) as age, round(coalesce(income, mi), 6) as income from d, m""",
)
def c2(t):
    d = t.v_dirty.select("id", clean.to_numeric("amount_s").alias("amount"), "age", "income")
    columns = ["amount", "age", "income"]
    filled = clean.fill_with(d, clean.fit_medians(d, columns), columns)
    return filled.select("id", r("amount").alias("amount"), "age", r("income").alias("income"))


MIX = {"_": 4, "Bad": 0, "Standard": 1, "Good": 2}


@query(
    "c3_recode",
    """select id, cast(case mix when '_' then 4 when 'Bad' then 0 when 'Standard' then 1 when 'Good' then 2 end as bigint) as mix from v_dirty""",
)
def c3(t):
    return t.v_dirty.select("id", big(clean.recode("mix", MIX)).alias("mix"))


@query(
    "c4_replace_values",
    """with m as (select former, arg_max(current, ord) as current from v_alias group by former)
    select s_suppkey, coalesce(a.current, n_name) as team, coalesce(b.current, s_name) as s_name
    from supplier join nation on s_nationkey = n_nationkey
    left join m a on n_name = a.former left join m b on s_name = b.former""",
)
def c4(t):
    names = t.nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("team"))
    rows = t.supplier.join(names, "s_nationkey").select("s_suppkey", "team", "s_name")
    return replace_values(rows, last_wins(t.v_alias, "former", "ord", "current"), "former", "current")


@query(
    "c4_replace_cells",
    """with m as (select l_orderkey as k, max(l_partkey) as v from lineitem where l_linenumber = 1 group by l_orderkey)
    select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, coalesce(a.v, l_partkey) as l_partkey, coalesce(b.v, l_suppkey) as l_suppkey
    from lineitem l left join m a on l.l_partkey = a.k left join m b on l.l_suppkey = b.k""",
)
def c4_cells(t):
    """Part and supplier keys of every line replaced by a dictionary with an entry for each order."""
    rows = t.lineitem.select("l_orderkey", big("l_linenumber").alias("l_linenumber"), "l_partkey", "l_suppkey")
    entries = t.lineitem.where("l_linenumber = 1").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("v"))
    return replace_cells(rows, entries, "k", "v", ["l_partkey", "l_suppkey"])


@query(
    "c5_range_to_null",
    """select id, cast(case when age >= 0 and age <= 99 then age end as bigint) as age, case when income <= 5000 then income end as income from v_dirty""",
)
def c5(t):
    d = clean.drop_out_of_range(t.v_dirty.select("id", "age", "income"), {"age": (0, 99), "income": (None, 5000.0)})
    return d.withColumn("age", big("age"))


@query(
    "c6_iqr_to_null",
    """with f as (select quantile_cont(cast(age as double), 0.25) as a1, quantile_cont(cast(age as double), 0.75) as a3,
      quantile_cont(income, 0.25) as i1, quantile_cont(income, 0.75) as i3 from v_dirty where id % 2 = 1)
    select id, cast(case when age >= a1 - 1.5 * (a3 - a1) and age <= a3 + 2.5 * (a3 - a1) then age end as bigint) as age,
      round(case when income >= i1 - 1.5 * (i3 - i1) and income <= i3 + 1.5 * (i3 - i1) then income end, 6) as income from v_dirty, f""",
)
def c6(t):
    d = t.v_dirty.select("id", "age", "income")
    fences = clean.fit_fences(d.filter("id % 2 = 1"), {"age": 2.5, "income": 1.5})
    return clean.apply_fences(d, fences, ["age", "income"]).select("id", big("age").alias("age"), r("income").alias("income"))


SQL_FILL = """with f as (select event_id, user_id, """ + ", ".join(
    f"""coalesce(last_value({c} ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row),
    first_value({c} ignore nulls) over (partition by user_id order by ts, event_id rows between current row and unbounded following)) as {c}"""
    for c in ("v1", "v2")
) + " from v_sparse)"


@query("c7_fill_by_key", SQL_FILL + " select event_id, user_id, v1, v2 from f")
def c7(t):
    return clean.fill_by_key(t.v_sparse, "user_id", ["ts", "event_id"], ["v1", "v2"], residual=False).select("event_id", "user_id", "v1", "v2")


@query(
    "c8_residual_median",
    SQL_FILL + ", m as (select median(v1) as m1, median(v2) as m2 from f) select event_id, round(coalesce(v1, m1), 6) as v1, round(coalesce(v2, m2), 6) as v2 from f, m",
)
def c8(t):
    return clean.fill_by_key(t.v_sparse, "user_id", ["ts", "event_id"], ["v1", "v2"]).select("event_id", r("v1").alias("v1"), r("v2").alias("v2"))


@query(
    "c9_missing_list",
    """select id, coalesce(len(string_split(loans, ', ')), 0) as n, coalesce(array_to_string(string_split(loans, ', '), '|'), '') as loans from v_dirty""",
)
def c9(t):
    d = t.v_dirty.select("id", clean.missing_list_to_empty(encode.split_list("loans")).alias("l"))
    return d.select("id", big(F.size("l")).alias("n"), F.array_join("l", "|").alias("loans"))


@query(
    "c10_months",
    r"""select id, coalesce(try_cast(regexp_extract(history, '(\d+)\sYears', 1) as bigint), 0) * 12
      + coalesce(try_cast(regexp_extract(history, '(\d+)\sMonths', 1) as bigint), 0) as months from v_dirty""",
)
def c10(t):
    return t.v_dirty.select("id", big(clean.months_of("history")).alias("months"))


@query("c11_flags_to_int", "select id, cast(is_error as bigint) as is_error from v_dirty")
def c11(t):
    return clean.flags_to_int(t.v_dirty.select("id", "is_error")).withColumn("is_error", big("is_error"))


# --- encoding and scaling ------------------------------------------------------------

PRIORITIES = ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "d1_one_hot",
    "select o_orderkey, " + ", ".join(f"""o_orderpriority = '{p}' as "o_orderpriority_{p}" """ for p in PRIORITIES) + " from orders",
)
def d1(t):
    rows = t.orders.select("o_orderkey", "o_orderpriority")
    return encode.one_hot(rows, encode.categories(rows, ["o_orderpriority"]))


@query(
    "d1_open_dictionary",
    """with c as (select l_orderkey, l_linenumber, unnest(['l_orderkey', 'l_partkey', 'l_returnflag']) as col, unnest([cast(l_orderkey as varchar), cast(l_partkey as varchar), l_returnflag]) as value from lineitem),
    d as (select col, value, row_number() over (order by col, value) - 1 as i from (select distinct col, value from c where value is not null))
    select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, i as place from c join d using (col, value)""",
)
def d1_open(t):
    """Places of the ones in sparse vectors over three columns with very many values."""
    columns = ["l_orderkey", "l_partkey", "l_returnflag"]
    rows = t.lineitem.select("l_linenumber", *columns)
    places = encode.encode_open(rows, columns, encode.fit_dictionary(rows, columns))
    return places.select("l_orderkey", big("l_linenumber").alias("l_linenumber"), F.explode("indices").alias("place"))


@query(
    "b7_sketched_distinct",
    """with c as (select l_shipdate, unnest(['l_orderkey', 'l_partkey', 'l_returnflag']) as col, unnest([cast(l_orderkey as varchar), cast(l_partkey as varchar), l_returnflag]) as value from lineitem)
    select col as "column", count(distinct value) as exact, count(value) as n, count(distinct l_shipdate) as parts, true as near from c group by col""",
)
def b7_sketched(t):
    """Distinct values from sketches kept per day; ``near`` says whether the estimate is within 5 % of the exact count."""
    columns = ["l_orderkey", "l_partkey", "l_returnflag"]
    found = inspect.sketched_distinct(inspect.distinct_sketches(t.lineitem, columns, ["l_shipdate"]))
    exact = encode.one_hot_long(t.lineitem, [], columns).groupBy("column").agg(F.countDistinct("value").alias("exact"))
    near = F.abs(F.col("distinct") - F.col("exact")) <= 0.05 * F.col("exact")
    return found.join(exact, "column").select("column", "exact", "n", "parts", near.alias("near"))


@query(
    "g9_sketched_quantiles",
    """with c as (select l_shipdate, unnest(['l_quantity', 'l_extendedprice', 'l_discount']) as col, unnest([l_quantity, l_extendedprice, l_discount]) as value from lineitem),
    n as (select col, count(value) as n, count(distinct l_shipdate) as parts from c group by col)
    select col as "column", q, n, parts, true as near from n, (select unnest([0.01::double, 0.25::double, 0.5::double, 0.75::double, 0.99::double]) as q)""",
)
def g9_sketched(t):
    """Quantiles from sketches kept per day; ``near`` says whether the true rank of each is within 0.02 of the one asked for."""
    kept = quantiles.quantile_sketches(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"], ["l_shipdate"])
    found = stage(quantiles.sketched_quantiles(kept, [0.01, 0.25, 0.5, 0.75, 0.99]), "estimates")
    errors = quantiles.rank_errors(t.lineitem, found)
    return found.join(errors.select("column", "q", "error"), ["column", "q"]).select("column", "q", "n", "parts", (F.col("error") <= 0.02).alias("near"))


@query(
    "d2_split_list",
    """with s as (select id, string_split(loans, ', ') as l from v_dirty)
    select id, cast(i - 1 as bigint) as pos, l[i] as token from s, range(1, 10) t(i) where i <= len(l)""",
)
def d2(t):
    return t.v_dirty.select("id", F.posexplode(encode.split_list("loans")).alias("pos", "token")).withColumn("pos", big("pos"))


TOKENS = ["Auto Loan", "Mortgage Loan", "Payday Loan", "and Auto Loan"]


@query(
    "d3_multi_hot",
    "with s as (select id, coalesce(string_split(loans, ', '), []) as l from v_dirty) select id, "
    + ", ".join(f"""cast(list_contains(l, '{x}') as bigint) as "{x}" """ for x in TOKENS)
    + " from s",
)
def d3(t):
    d = t.v_dirty.select("id", clean.missing_list_to_empty(encode.split_list("loans")).alias("loans"))
    tokens = encode.fit_tokens(d.filter("id % 2 = 1"), "loans")
    wide = encode.multi_hot(d, "loans", tokens).drop("loans")
    return wide.select("id", *[big(F.col(f"`{x}`")).alias(x) for x in tokens])


@query(
    "d4_standardise",
    """with s as (select avg(l_quantity) as mq, stddev_pop(l_quantity) as sq, avg(l_extendedprice) as me, stddev_pop(l_extendedprice) as se from lineitem)
    select l_orderkey, round((l_quantity - mq) / sq, 6) + 0.0 as l_quantity, round((l_extendedprice - me) / se, 6) + 0.0 as l_extendedprice from lineitem, s""",
)
def d4(t):
    d = t.lineitem.select("l_orderkey", "l_quantity", "l_extendedprice")
    columns = ["l_quantity", "l_extendedprice"]
    return encode.standardise(d, encode.fit_standard(d, columns), columns).withColumns({c: r(c) for c in columns})


SQL_THREE = """with h as (select *, row_number() over (order by md5('0:' || o_orderkey)) as rk, count(*) over () as n from orders),
    s as (select *, case when rk <= floor(n * 0.7) then 'train' when rk <= floor(n * 0.85) then 'val' else 'test' end as split from h)"""


@query(
    "d5_train_statistics",
    SQL_THREE + """, f as (select avg(o_totalprice) as m, stddev_pop(o_totalprice) as sd from s where split = 'train')
    select o_orderkey, split, round((o_totalprice - m) / sd, 6) + 0.0 as o_totalprice from s, f""",
)
def d5(t):
    d = sample.three_way(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey")
    stats = encode.fit_standard(d.filter("split = 'train'"), ["o_totalprice"])
    return encode.standardise(d, stats, ["o_totalprice"]).withColumn("o_totalprice", r("o_totalprice"))


SERIES = ["open", "high", "low", "close", "volume"]


@query(
    "d6_min_max",
    "with s as (select "
    + ", ".join(f"min({c}) as a_{c}, max({c}) as b_{c}" for c in SERIES)
    + " from v_series) select t, "
    + ", ".join(f"round(({c} - a_{c}) / (b_{c} - a_{c}), 6) + 0.0 as {c}" for c in SERIES)
    + " from v_series, s",
)
def d6(t):
    scaled = encode.min_max(t.v_series, encode.fit_min_max(t.v_series, SERIES), SERIES)
    return scaled.select("t", *[r(c).alias(c) for c in SERIES])


@query("d7_inverse_transform", "select l_orderkey, round(l_quantity, 6) as l_quantity, round(l_extendedprice, 4) as l_extendedprice from lineitem")
def d7(t):
    d = t.lineitem.select("l_orderkey", "l_quantity", "l_extendedprice")
    columns = ["l_quantity", "l_extendedprice"]
    stats = encode.fit_standard(d, columns)
    back = encode.unstandardise(encode.standardise(d, stats, columns), stats, {c: c for c in columns})
    return back.select("l_orderkey", r("l_quantity").alias("l_quantity"), r("l_extendedprice", 4).alias("l_extendedprice"))


@query(
    "d8_label_indicators",
    "select vec_id, cast(i as bigint) as class, cast(label = i as bigint) as hit from embeddings, range(0, 10) t(i)",
)
def d8(t):
    k = one_hot_label("label", 10)
    return t.embeddings.select("vec_id", F.posexplode(k).alias("class", "hit")).select("vec_id", big("class").alias("class"), big("hit").alias("hit"))


@query(
    "d9_class_weights",
    """with c as (select label, count(*) as n from embeddings group by label), w as (select label, n, sum(n) over () / n as raw from c)
    select cast(label as bigint) as label, n, round(raw / sum(raw) over (), 8) as weight from w""",
)
def d9(t):
    return encode.class_weights(t.embeddings, "label").select(big("label").alias("label"), "n", r("weight", 8).alias("weight"))


SQL_PRED = """with p as (select row_id, cast(y as bigint) as y, cast(list_position(logits, list_max(logits)) - 1 as bigint) as pred from v_scored)"""


@query(
    "d10_score_weights",
    SQL_PRED + """, k as (select distinct unnest([y, pred]) as c from p),
    s as (select c, coalesce(avg(case when y = c then 1.0 else 0.0 end) filter (where pred = c), 0.0) as precision from k, p group by c),
    w as (select c, 1 / (precision + 0.0001) as raw from s)
    select cast(c as varchar) as name, round(raw / sum(raw) over (), 8) as weight from w""",
)
def d10(t):
    d = t.v_scored.select("y", argmax("logits").alias("pred"))
    per_class = evaluate.report(evaluate.observed(d, "y", "pred")).filter("name rlike '^[0-9]+$'")
    return encode.score_weights(per_class.select("name", "precision"), "precision").select("name", r("weight", 8).alias("weight"))


@query(
    "d11_scale_varied",
    """with s as (select avg(income) as m, stddev_pop(income) as sd from v_dirty)
    select id, cast(age as double) as age, round((income - m) / sd, 6) + 0.0 as income, cast(is_error as double) as is_error from v_dirty, s""",
)
def d11(t):
    d = t.v_dirty.select("id", F.col("age").cast("double").alias("age"), "income", F.col("is_error").cast("int").cast("double").alias("is_error"))
    target = "age"
    chosen = [c for c in encode.varied_columns(d, ["age", "income", "is_error"]) if c != target]
    scaled = encode.standardise(d, encode.fit_standard(d, chosen), chosen)
    return scaled.withColumns({c: r(c) for c in chosen})


@query("d12_last_token", "select o_orderkey, string_split(o_orderpriority, '-')[-1] as name from orders")
def d12(t):
    return t.orders.select("o_orderkey", last_token("o_orderpriority").alias("name"))


@query(
    "d13_assemble",
    """select l_orderkey, cast(cast(l_quantity as float) as double) as f0, cast(cast(l_extendedprice as float) as double) as f1,
      cast(cast(l_discount as float) as double) as f2 from lineitem""",
)
def d13(t):
    d = t.lineitem.select("l_orderkey", encode.assemble(["l_quantity", "l_extendedprice", "l_discount"]).alias("x"))
    return d.select("l_orderkey", *[F.col("x")[i].cast("double").alias(f"f{i}") for i in range(3)])


@query(
    "d14_append_columns",
    r"""select a.id, a.category, b.months, b.mix from v_dirty a join (select id, coalesce(try_cast(regexp_extract(history, '(\d+)\sYears', 1) as bigint), 0) * 12
      + coalesce(try_cast(regexp_extract(history, '(\d+)\sMonths', 1) as bigint), 0) as months,
      cast(case mix when '_' then 4 when 'Bad' then 0 when 'Standard' then 1 when 'Good' then 2 end as bigint) as mix from v_dirty) b on a.id = b.id""",
)
def d14(t):
    return t.v_dirty.select("id", "category", big(clean.months_of("history")).alias("months"), big(clean.recode("mix", MIX)).alias("mix"))


# --- splits and batches --------------------------------------------------------------


@query(
    "e1_random_split",
    """with h as (select doc_id, row_number() over (order by md5('0:' || doc_id)) as rk, count(*) over () as n from documents)
    select doc_id, case when rk <= floor(n * 0.8) then 'train' else 'test' end as split from h""",
)
def e1(t):
    return sample.train_test(t.documents.select("doc_id"), "doc_id")


@query(
    "e1_hash_split",
    """select doc_id, case when ('0x' || substr(md5('7:' || doc_id), 1, 8))::bigint < 3435973837 then 'train' else 'test' end as split from documents""",
)
def e1_hash(t):
    return sample.hash_split(t.documents.select("doc_id"), "doc_id", {"train": 0.8, "test": 0.2}, seed=7)


@query(
    "e2_seeded_split",
    """with h as (select doc_id, row_number() over (order by md5('42:' || doc_id)) as rk, count(*) over () as n from documents)
    select doc_id, case when rk <= n - ceil(n * 0.2) then 'train' else 'test' end as split from h""",
)
def e2(t):
    return sample.train_test_ceil(t.documents.select("doc_id"), "doc_id")


@query(
    "e3_sequential_split",
    """with h as (select t, open, close, row_number() over (order by t) as rk, count(*) over () as n from v_series)
    select t, open, close, case when rk <= n - ceil(n * 0.2) then 'train' else 'test' end as split from h""",
)
def e3(t):
    return sample.sequential_split(t.v_series.select("t", "open", "close"), ["t"])


@query("e4_three_way_split", SQL_THREE + " select o_orderkey, split from s")
def e4(t):
    return sample.three_way(t.orders.select("o_orderkey"), "o_orderkey")


@query("e5_row_shuffle", "select event_id, row_number() over (order by md5('3:' || event_id), event_id) as rank from events")
def e5(t):
    return sample.shuffle_rank(t.events.select("event_id"), "event_id", seed=3).select("event_id", "rank")


@query(
    "e6_batches",
    """with h as (select event_id, value, row_number() over (order by md5('5:' || event_id), event_id) as rk from events)
    select cast(floor((rk - 1) / 128) as bigint) as batch, count(*) as n, round(sum(value), 4) as total, min(event_id) as first_id from h group by 1""",
)
def e6(t):
    rows = sample.batches(t.events.select("event_id", "value"), "event_id", 128, seed=5)
    return rows.groupBy(big("batch").alias("batch")).agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("value"), 4).alias("total"), F.min("event_id").alias("first_id")
    )


@query(
    "x1_ordered_rank_sum",
    """select event_id, row_number() over (order by ts, event_id) as rank, round(sum(value) over (order by ts, event_id), 3) as running from events""",
)
def x1(t):
    rows = scan(t.events.select("event_id", "ts", "value"), ["ts", "event_id"], sums={"running": "value"})
    return rows.select("event_id", "rank", r("running", 3).alias("running"))


@query(
    "x1_ordered_rank_by_key",
    """select event_id, event_type, row_number() over (partition by event_type order by ts, event_id) as rank,
      round(sum(value) over (partition by event_type order by ts, event_id), 3) as running from events""",
)
def x1_by_key(t):
    rows = scan(t.events.select("event_id", "event_type", "ts", "value"), ["ts", "event_id"], ["event_type"], sums={"running": "value"})
    return rows.select("event_id", "event_type", "rank", r("running", 3).alias("running"))
