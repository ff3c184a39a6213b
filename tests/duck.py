"""Results of Spark and DuckDB in a form that can be compared."""

import glob
import os

DATA = "/root/testdata/sf0.001"


def text(v):
    if v is None or v != v:
        return "NULL"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(text(r[c]) for c in columns) for r in df.collect())


def duck_rows(sql, folder=DATA):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    found = con.sql(sql)
    columns = sorted(found.columns)
    at = [found.columns.index(c) for c in columns]
    return columns, sorted(tuple(text(r[i]) for i in at) for r in found.fetchall())
