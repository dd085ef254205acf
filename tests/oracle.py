"""Comparison of a query with its SQL, run by DuckDB over the same files."""

import math
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return v


def connect(folder):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in os.listdir(folder):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{folder}/{f}'")
    return con


def assert_equal(con, df, sql):
    rows, cols = df.collect(), df.columns
    found = con.sql(sql)
    assert sorted(cols) == sorted(found.columns)
    order = sorted(cols)
    at = [found.columns.index(c) for c in order]
    mine = sorted((tuple(plain(r[c]) for c in order) for r in rows), key=repr)
    other = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
    assert mine == other
