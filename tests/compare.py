"""Runs a query on Spark and its SQL on DuckDB over the same tables and compares columns and rows."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(base: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in glob.glob(f"{base}/*.parquet"):
        q = p if os.path.isfile(p) else f"{p}/*.parquet"
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{q}')")
    return c


def _plain(v):
    if isinstance(v, float):
        return round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _plain(x)) for k, x in v.items()))
    return v


def assert_same(spark, con, base: str, query, sql: str) -> None:
    df = query(spark, base)
    columns = sorted(df.columns)
    got = sorted(repr(_plain(tuple(r))) for r in df.select(columns).collect())
    con.execute(sql)
    names = [c[0] for c in con.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted(repr(_plain(tuple(r[i] for i in at))) for r in con.fetchall())
    assert got == want
