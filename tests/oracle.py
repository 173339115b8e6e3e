"""Compare a query with its SQL in DuckDB, as the driver does."""

import decimal
import math
import os

import duckdb

from tessera.plans.inputs import TABLES


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def same(spark, d, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{d}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    df, got = query(spark, d), con.sql(sql)
    columns = sorted(df.columns)
    assert sorted(got.columns) == columns
    at = [got.columns.index(c) for c in columns]
    a = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    b = sorted((tuple(plain(r[i]) for i in at) for r in got.fetchall()), key=repr)
    assert len(a) == len(b)
    assert a == b, [(x, y) for x, y in zip(a, b) if x != y][:3]
