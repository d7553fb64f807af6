"""Order-free comparison of a Spark query with its DuckDB text on the same tables."""

from __future__ import annotations

import glob
import os

import duckdb

SF = "/root/testdata/sf0.001"


def connect(sf: str = SF) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def cell(x):
    if isinstance(x, float):
        return repr(round(x, 6) + 0.0)
    if getattr(x, "tzinfo", None) is not None:
        x = x.replace(tzinfo=None)
    return str(x)


def same(spark, name: str, query, sql: str, c, sf: str = SF) -> None:
    df = query(spark, sf)
    columns = sorted(df.columns)
    mine = sorted(tuple(cell(r[k]) for k in columns) for r in df.collect())
    found = c.sql(sql)
    assert sorted(found.columns) == columns, name
    at = [found.columns.index(k) for k in columns]
    theirs = sorted(tuple(cell(r[i]) for i in at) for r in found.fetchall())
    assert mine == theirs, name
