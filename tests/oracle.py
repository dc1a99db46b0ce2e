"""Comparing a query with its SQL twin."""

import os

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def text(v):
    if v is None or v is pd.NaT or isinstance(v, float) and np.isnan(v):
        return "~"
    return str(pd.Timestamp(v)) if hasattr(v, "year") else str(v)


def sorted_rows(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        numeric = pd.api.types.is_numeric_dtype(df[c]) and not pd.api.types.is_bool_dtype(df[c])
        df[c] = df[c].astype(float).round(6).fillna(-9e99) + 0.0 if numeric else df[c].map(text)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def assert_same(spark, query, sql, sf_dir):
    got, want = sorted_rows(query(spark, sf_dir).toPandas()), sorted_rows(connect(sf_dir).execute(sql).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got.columns:
        if got[c].dtype == float:
            assert np.allclose(got[c], want[c], rtol=1e-9, atol=1e-12), c
        else:
            assert (got[c] == want[c]).all(), c
