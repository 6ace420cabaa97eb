"""Compare a query with its SQL in DuckDB."""

import datetime
import glob
import os

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = [os.path.basename(p)[:-8] for p in glob.glob(f"{SF}/*.parquet")]


def plain(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, datetime.datetime):
        return value.isoformat()[:10] if value.time() == datetime.time() else value.isoformat()
    return None if value is None else str(value)


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) or "" for i in order) for r in found)


def same(spark, query, sql, sf_dir=SF):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS FROM '{sf_dir}/{name}.parquet'")
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    got = query(spark, sf_dir)
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())
