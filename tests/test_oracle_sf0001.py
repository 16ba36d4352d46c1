"""Every registered query against its DuckDB twin on the smallest tables."""


import duckdb
import pytest

import __spark_entry__ as E
from briefloom.plans.oracle import ORACLE_SQL
from briefloom.plans.queries import QUERIES
from conftest import SF_SMALL

TABLES = ["events", "documents", "pages", "benchmark", "conversations"]
NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def _norm(v):
    if v is None:
        return "<null>"
    if isinstance(v, bool):
        return str(v).lower()
    return str(v)


def _rows(cols, recs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in recs)


def test_every_query_has_an_oracle():
    assert set(ORACLE_SQL) == set(QUERIES) and set(QUERIES) <= set(E.queries())
    assert set(ORACLE_SQL) <= set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    rel = con.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(rel.columns, rel.fetchall())


def test_entry_smoke(spark):
    assert E.entry(spark).count() >= 0
