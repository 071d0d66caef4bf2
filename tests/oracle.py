"""Runs a query and its SQL over one directory of tables and compares their rows, whatever their order."""

import datetime
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    db = duckdb.connect()
    db.sql("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return db


def _plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return ""
    if isinstance(v, (pd.Timestamp, datetime.date)):
        return str(v)[:10]
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def assert_same(df, db, sql):
    mine, theirs = df.toPandas(), db.sql(sql).df()
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    tidy = lambda x: x[columns].map(_plain).sort_values(columns).reset_index(drop=True)
    pd.testing.assert_frame_equal(tidy(mine), tidy(theirs))
    return mine
