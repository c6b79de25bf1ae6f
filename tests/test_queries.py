"""Every query with SQL is compared with DuckDB; the others return rows."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from linkloom.plans import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: None if v is None else str(v)) if df[c].dtype == object else df[c].astype(float)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tiny, name):
    query, sql = QUERIES[name]
    got = query(spark, tiny).toPandas()
    if sql is None:
        assert len(got)
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{tiny}/{t}.parquet'")
    pd.testing.assert_frame_equal(normal(got), normal(con.execute(sql).df()), check_dtype=False)


def test_entry_and_registry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).count() > 0
