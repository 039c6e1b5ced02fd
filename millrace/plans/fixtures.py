"""The given tables and the views the registered queries read, in both SQL dialects."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()

VIEWS = {
    "v_matches": """
select o_orderkey as match_id, o_orderdate as dt, concat(c_mktsegment, '-', cast(cast(floor(c_custkey / 150) as bigint) as string)) as pool, cast(c_nationkey as bigint) as home,
  (c_nationkey + 1 + o_orderkey % 24) % 25 as away, (o_orderkey * 7 + o_custkey) % 5 as home_score, (o_orderkey * 3 + o_custkey * 5) % 4 as away_score,
  case o_orderpriority when '1-URGENT' then 'FIFA World Cup' when '2-HIGH' then 'copa américa' when '3-MEDIUM' then 'UEFA Euro qualification' when '4-NOT SPECIFIED' then 'Friendly' else 'King''s Cup' end as tournament
from orders join customer on o_custkey = c_custkey""",
    "v_dirty": """
select event_id as id, user_id as customer_id, event_type as category, event_type = 'error' as is_error,
  case when event_id % 17 = 0 then concat(cast(value as string), '_') when event_id % 23 = 0 then '' when event_id % 29 = 0 then null when event_id % 31 = 0 then concat(cast(value as string), 'd') else cast(value as string) end as amount_s,
  case when event_id % 41 = 0 then null when event_id % 19 = 0 then -500 when event_id % 37 = 0 then 8000 else 18 + event_id % 60 end as age,
  case when event_id % 43 = 0 then null else value * 100 end as income,
  case event_id % 5 when 0 then '_' when 1 then 'Bad' when 2 then 'Standard' when 3 then 'Good' else 'Other' end as mix,
  case when event_id % 11 = 0 then null when event_id % 13 = 0 then '7 Months' when event_id % 7 = 0 then concat(cast(event_id % 30 as string), ' Years') else concat(cast(event_id % 30 as string), ' Years and ', cast(event_id % 12 as string), ' Months') end as history,
  case event_id % 6 when 0 then null when 1 then 'Auto Loan' when 2 then 'Auto Loan, Payday Loan, and Student Loan' when 3 then 'Payday Loan, Payday Loan' when 4 then 'Student Loan, Mortgage Loan' else 'Mortgage Loan, and Auto Loan' end as loans
from events""",
    "v_sparse": """
select event_id, user_id, ts, case when event_id % 5 in (0, 1) then null else value end as v1,
  case when user_id % 7 = 0 or event_id % 3 = 0 then null else value end as v2 from events""",
    "v_series": """
select event_id as t, value as open, value + 1 + event_id % 7 as high, value - event_id % 3 as low,
  value + 0.5 * (event_id % 5 - 2) as close, cast(user_id as double) as volume from events""",
    "v_binary": """
select l.doc_id as row_id, l.quality as y, cast(floor(cast(d.n_chars as double) / 500) as double) as score from labels l join documents d on l.doc_id = d.doc_id""",
    "v_regress": """
select l_orderkey, l_linenumber, l_quantity, l_discount, p_size, p_retailprice, l_extendedprice as y, l_quantity * p_retailprice as pred from lineitem join part on l_partkey = p_partkey""",
    "v_runlog": """
select user_id as run_id, row_number() over (partition by user_id order by ts, event_id) as epoch, value as loss, 1 + event_id % 32 as n from events""",
    "v_files": """
select doc_id as file_id, concat('data/', source, '/', lang, '_', source, '_', cast(doc_id as string), case when doc_id % 10 = 0 then '.png' else '.jpg' end) as path,
  case when doc_id % 3 = 0 then 300 else 150 + doc_id % 200 end as width, case when doc_id % 4 = 0 then 162 else 120 + doc_id % 180 end as height from documents""",
    "v_alias": """
select n_name as former, concat('TEAM ', cast(n_regionkey as string)) as current, n_nationkey as ord from nation where n_nationkey % 2 = 0""",
    "v_scored": """
select vec_id as row_id, label as y, transform(sequence(1, 10), k -> aggregate(filter(embedding, (x, i) -> i % 10 = k - 1), 0D, (s, x) -> s + cast(x as double)) * 10) as logits from embeddings""",
    "v_image": """
select vec_id as row_id, label, transform(embedding, x -> least(255.0, cast(floor(abs(cast(x as double)) * 500) as double))) as px from embeddings""",
}

DUCK_VIEWS = VIEWS | {
    "v_scored": """
select vec_id as row_id, label as y, list_transform(range(1, 11), lambda k: list_reduce(list_transform(list_filter(embedding, lambda x, i: (i - 1) % 10 = k - 1), lambda x: cast(x as double)), lambda s, x: s + x, 0::double) * 10) as logits from embeddings""",
    "v_image": """
select vec_id as row_id, label, list_transform(embedding, lambda x: least(255.0, cast(floor(abs(cast(x as double)) * 500) as double))) as px from embeddings""",
}


class Inputs:
    """Tables and views of one scale folder as attributes: ``inputs.orders``, ``inputs.v_matches``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        elif name in VIEWS:
            used = {t: getattr(self, t) for t in TABLES if re.search(rf"\b(from|join) {t}\b", VIEWS[name])}
            text = re.sub(r"\b(from|join) (\w+)", lambda m: f"{m[1]} {{{m[2]}}}", VIEWS[name])
            df = self.spark.sql(text, **used)
        else:
            raise AttributeError(name)
        setattr(self, name, df)
        return df


def duck_sql(sql: str) -> str:
    """Prefix the views a DuckDB statement mentions."""
    sql = sql.strip()
    used = [v for v in DUCK_VIEWS if re.search(rf"\b{v}\b", sql)]
    parts = [f"{v} as ({DUCK_VIEWS[v].strip()})" for v in used]
    if not parts:
        return sql
    head = re.match(r"with(\s+recursive)?\s+", sql, re.IGNORECASE)
    body = ", " + sql[head.end() :] if head else " " + sql
    return "with recursive " + ", ".join(parts) + body
