"""Compare a query's rows with its SQL in DuckDB."""

import glob
import os

import duckdb


def rows_equal(spark, query, sql, sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    want = sorted(map(str, found.fetchall()))
    df = query(spark, sf_dir)
    assert sorted(columns) == sorted(df.columns)
    assert sorted(str(tuple(r[c] for c in columns)) for r in df.collect()) == want
