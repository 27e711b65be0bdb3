from __future__ import annotations

import duckdb
import pytest

from tidemark.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in ("nation", "region", "customer", "supplier", "part", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DIR}/{name}.parquet')")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, DIR)
    cursor = db.execute(ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    norm = lambda v: round(v, 6) if isinstance(v, float) else v
    want = sorted(repr([norm(v) for v in row]) for row in cursor.fetchall())
    assert sorted(repr([norm(row[c]) for c in columns]) for row in df.collect()) == want
