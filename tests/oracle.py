"""Comparing a query with its SQL in DuckDB, order and float noise aside."""

import os

import duckdb
import pandas as pd


def connect(sf_dir):
    con = duckdb.connect()
    for t in os.listdir(sf_dir):
        p = f"{sf_dir}/{t}"
        con.sql(f"create view {t.split('.')[0]} as select * from read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return con


def _value(x):
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and x != x:
        return "-"
    if isinstance(x, bool) or type(x).__name__ == "bool_":
        return str(bool(x))
    try:
        return "%.8g" % float(x)
    except (TypeError, ValueError):
        return str(x)


def canonical(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(_value(x) for x in r) for r in df.itertuples(index=False))


def assert_same(spark_df, con, sql):
    a, b = spark_df.toPandas(), con.sql(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert canonical(a) == canonical(b)
