"""Run registered queries on Spark and their SQL on DuckDB and compare the rows.

    python compare.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import math
import time
import traceback
from pathlib import Path

import duckdb

from doctables.session import builder
from doctables.workload import ORACLES, QUERIES

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf: str, name: str) -> tuple[str, float]:
    started = time.time()
    df = QUERIES[name](spark, sf)
    got = rows_of(df.columns, df.collect())
    took = time.time() - started
    if name not in ORACLES:
        return f"rows only ({len(got)})", took
    out = con.execute(ORACLES[name])
    columns = [d[0] for d in out.description]
    wanted = rows_of(columns, out.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} / {sorted(columns)}", took
    if got != wanted:
        only = [x for x in got if x not in set(wanted)][:2]
        other = [x for x in wanted if x not in set(got)][:2]
        return f"DIFFERENT {len(got)}/{len(wanted)}\n    spark {only}\n    sql   {other}", took
    types = {d[0]: str(d[1]) for d in out.description}
    odd = [
        f"{c}:{t}/{types[c]}" for c, t in df.dtypes
        if TYPES.get(t, t) != types[c]
    ]
    return f"ok {len(got)}" + (f"  types {odd}" if odd else ""), took


def connect(sf: str):
    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


if __name__ == "__main__":
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = (
        builder("compare").master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    for name in args.names or QUERIES:
        try:
            verdict, took = compare(spark, con, args.sf, name)
        except Exception as e:
            lines = str(e).splitlines() or [""]
            where = traceback.extract_tb(e.__traceback__)[-1]
            verdict, took = f"ERROR {type(e).__name__} {' '.join(lines[:3])[:500]} @ {where.filename.split('/')[-1]}:{where.lineno}", 0
        print(f"{name:28} {took:6.2f}s  {verdict}", flush=True)
