import pytest

import __spark_entry__ as entry
from assaymill.plans import registry
from tests.oracle import connect, rows_of

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    want = duck.execute(SQL[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) > 0
    assert [r.score for r in rows] == sorted((r.score for r in rows), reverse=True)
