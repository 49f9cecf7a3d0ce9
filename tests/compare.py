"""Compare a query with its SQL in DuckDB, as sorted rows."""

from __future__ import annotations

import math
import os

import duckdb


def tables(con, sf_dir):
    for f in os.listdir(sf_dir):
        name = f.split(".")[0]
        path = f"{sf_dir}/{f}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{f}") else "")
        con.sql(f"create view {name} as select * from '{path}'")


def oracle(sql, sf_dir):
    con = duckdb.connect()
    tables(con, sf_dir)
    r = con.sql(sql)
    return r.columns, r.fetchall()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(_norm(r[i]) for i in order) for r in rows], key=lambda r: tuple((x is None, str(type(x)), x) if not isinstance(x, (list, dict)) else (False, "l", str(x)) for x in r))


def assert_same(df, sql, sf_dir):
    columns, want = oracle(sql, sf_dir)
    assert sorted(df.columns) == sorted(columns), (df.columns, columns)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    want = rows_of(columns, want)
    assert len(got) == len(want), (len(got), len(want))
    for g, w in zip(got, want):
        assert g == w, (g, w)
    return len(got)
