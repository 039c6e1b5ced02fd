"""Run registered queries next to their SQL: python tests/compare.py [sf] [name ...]"""

from __future__ import annotations

import math
import os
import re
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from millrace.plans.fixtures import TABLES  # noqa: E402
from millrace.session import local_session  # noqa: E402


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return str(v)


NAMES = {"bigint": "bigint", "int": "int", "integer": "int", "double": "double", "varchar": "string", "string": "string", "boolean": "boolean"}


def family(kind: str) -> str:
    """Both engines must give the same plain type; anything else stands out as itself."""
    return NAMES.get(kind.lower(), kind)


def spark_side(df):
    names = sorted(df.columns)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    rows = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    return names, [kinds[c] for c in names], rows


def duck_side(con, sql):
    rel = con.execute(sql)
    cols = [(d[0], str(d[1])) for d in rel.description]
    order = sorted(range(len(cols)), key=lambda i: cols[i][0])
    rows = sorted(tuple(plain(r[i]) for i in order) for r in rel.fetchall())
    return [cols[i][0] for i in order], [cols[i][1] for i in order], rows


def differences(spark, con, folder, name) -> str | None:
    df = entry.queries()[name](spark, folder)
    names, kinds, rows = spark_side(df)
    plan = df._jdf.queryExecution().executedPlan().toString()
    crossed = [p for p in ("CartesianProduct", "BroadcastNestedLoopJoin") if p in plan]
    if crossed or re.search(r"Window \[.*\n.*Sort.*\n.*Exchange SinglePartition", plan):
        return f"plan has {crossed or 'a window over everything'}"
    if name not in entry.oracle_sql():
        return None if rows else "no rows"
    names2, kinds2, rows2 = duck_side(con, entry.oracle_sql()[name])
    if names != names2:
        return f"columns {names} / {names2}"
    if [family(k) for k in kinds] != [family(k) for k in kinds2]:
        return f"types {list(zip(names, kinds, kinds2))}"
    if len(rows) != len(rows2):
        return f"rows {len(rows)} / {len(rows2)}; e.g. {rows[:2]} / {rows2[:2]}"
    bad = [(a, b) for a, b in zip(rows, rows2) if a != b]
    if bad:
        return f"{len(bad)} of {len(rows)} rows differ: {names} {bad[0][0]} / {bad[0][1]}"
    return None if rows else "no rows on either side"


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    folder = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, wrong = duck(folder), 0
    wanted = sys.argv[2:] or list(entry.queries())
    wanted = [n for n in entry.queries() if any(n == w or n.startswith(w + "_") for w in wanted)]
    for name in wanted:
        began = time.time()
        try:
            found = differences(spark, con, folder, name)
        except Exception as e:  # noqa: BLE001
            found = "".join(traceback.format_exception_only(e))[-1500:]
            if "-v" in os.environ.get("COMPARE", ""):
                traceback.print_exc()
        wrong += found is not None
        mark = "ok  " if found is None else "DIFF"
        print(f"{mark} {name:34s} {time.time() - began:6.2f}s {'' if name in entry.oracle_sql() else '(rows only)'} {found or ''}", flush=True)
    print("checked", len(wanted), "wrong", wrong)
