"""Side-by-side comparison of a Spark query and its SQL in DuckDB."""

import glob
import math
import numbers
import os

import duckdb

TABLES = "/root/testdata/sf0.001"


def connection(sf_dir=TABLES):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def value(x):
    if x is None or str(x) in ("NaT", "<NA>") or (isinstance(x, float) and math.isnan(x)):
        return "NULL"
    if isinstance(x, numbers.Number) and str(x) not in ("True", "False"):
        return repr(float(x))
    return str(x)


def rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(value(x) for x in r) for r in df[names].itertuples(index=False))


def same(query, sql, spark, sf_dir=TABLES):
    assert rows(query(spark, sf_dir).toPandas()) == rows(connection(sf_dir).execute(sql).df())
