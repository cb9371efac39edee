"""Compares a query with its SQL on the same tables."""

import math
import numbers
import os

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def cell(v):
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, numbers.Number | np.number) and not isinstance(v, bool | np.bool_):
        return str(round(float(v), 6))
    return str(v)


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(tuple(cell(v) for v in r) for r in frame[names].itertuples(index=False))


def same(spark_df, con, sql):
    a, b = rows(spark_df.toPandas()), rows(con.sql(sql).df())
    assert a[0] == b[0]
    assert len(a[1]) == len(b[1])
    assert a[1] == b[1]
