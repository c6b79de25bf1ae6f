"""Registered queries against SQL and the given tables."""

import duckdb
import pytest

from linkloom.llm.queries import ORACLE_SQL, QUERIES
from tests.test_queries import TABLES, normal


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, tiny, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{tiny}/{t}.parquet'")
    got, want = normal(QUERIES[name](spark, tiny).toPandas()), normal(con.execute(ORACLE_SQL[name]).df())
    assert got.fillna("-").equals(want.fillna("-"))


@pytest.mark.parametrize("name", ["op7_toxicity", "op9_language_id"])
def test_held_out_columns(spark, tiny, name):
    rows = QUERIES[name](spark, tiny).collect()
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
