"""Runs a registered query in Spark and its SQL in DuckDB and compares columns and rows."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import os
import time

import duckdb


def duck(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{root}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(v):
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        f = float(v)
        return str(int(v)) if f == int(f) and abs(f) < 2 ** 63 and isinstance(v, int) else repr(round(f, 9))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, root, name, fn, sql, con=None):
    """(ok, message, spark seconds, duckdb seconds)."""
    con = con or duck(root)
    t = time.time()
    df = fn(spark, root)
    got = df.collect()
    spark_s, t = time.time() - t, time.time()
    if sql is None:
        return bool(got), f"{len(got)} rows, no SQL", spark_s, 0.0
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    duck_s = time.time() - t
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} against {sorted(names)}", spark_s, duck_s
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b:
        return True, f"{len(a)} rows", spark_s, duck_s
    extra, missing = [x for x in a if x not in set(b)][:2], [x for x in b if x not in set(a)][:2]
    return False, f"{len(a)} rows against {len(b)}; only in Spark {extra}; only in SQL {missing}", spark_s, duck_s
