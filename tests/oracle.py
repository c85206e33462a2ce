"""Compare a query with its SQL on the small tables."""

import glob
import math
import os

import duckdb
import pandas as pd

DATA = os.environ.get("QUERNSTONE_TESTDATA", "/root/testdata/sf0.001")


def connection(data=DATA):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for p in glob.glob(f"{data}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def _normal(df):
    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return ""
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float)) or hasattr(v, "dtype"):
            return f"{float(v):.9g}" if not hasattr(v, "tolist") or not isinstance(v.tolist(), (bool, list)) else str(v.tolist())
        return str(v)

    return sorted(tuple(cell(v) for v in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False))


def same(spark_df, sql, c):
    a, b = spark_df.toPandas(), c.sql(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert _normal(a) == _normal(b)
