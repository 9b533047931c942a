"""Every registered query with SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from agora.plans.queries import ORACLE_SQL, QUERIES

from .conftest import SF


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    df, rel = QUERIES[name](spark, SF), duck.sql(ORACLE_SQL[name])
    cols, theirs = sorted(df.columns), list(rel.columns)
    assert sorted(theirs) == cols
    got = sorted(tuple(str(r[c]) for c in cols) for r in df.collect())
    assert got == sorted(tuple(str(r[theirs.index(c)]) for c in cols) for r in rel.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
