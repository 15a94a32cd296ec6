"""Every query with SQL gives the rows of its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from parlance.plans import event_queries, frame_queries, queries, table_queries

QUERIES = queries.QUERIES | table_queries.QUERIES | frame_queries.QUERIES | event_queries.QUERIES
ORACLE_SQL = queries.ORACLE_SQL | table_queries.ORACLE_SQL | frame_queries.ORACLE_SQL | event_queries.ORACLE_SQL

DIR = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DIR}/{f}')")
    return con


def plain(rows):
    clean = lambda v: round(v, 9) if isinstance(v, float) and math.isfinite(v) else v
    return sorted([tuple(clean(v) for v in r) for r in rows], key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, db, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    want = db.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert plain(df.select(columns).collect()) == plain(want)
    assert want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0
