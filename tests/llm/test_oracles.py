"""Queries that SQL can tell, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from logloom.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the generated tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    norm = lambda x: round(x, 6) + 0.0 if isinstance(x, float) else x
    got = sorted(tuple(map(norm, r)) for r in df.select(*columns).collect())
    want = duck.sql(ORACLE_SQL[name])
    at = [want.columns.index(c) for c in columns]
    assert len(want.columns) == len(columns)
    assert got == sorted(tuple(norm(x[k]) for k in at) for x in want.fetchall())
