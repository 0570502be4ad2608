"""Runs a query and its SQL over the same tables."""

import os
from pathlib import Path

import duckdb

TABLES = "documents labels pages conversations benchmark embeddings nation region".split()


def sql_rows(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    out = con.sql(sql)
    order = sorted(range(len(out.columns)), key=lambda i: out.columns[i])
    return sorted(out.columns), sorted((tuple(r[i] for i in order) for r in out.fetchall()), key=str)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(r) for r in df.select(*names).collect()), key=str)
