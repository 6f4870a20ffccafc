"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as driver
from tests.compare import connect, difference

QUERIES, SQL = driver.queries(), driver.oracle_sql()
SLOW_ROWS_ONLY = {"raptor_tree", "embed_cluster"}


@pytest.fixture(scope="module")
def con(small_dir):
    return connect(small_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, small_dir, name):
    got = QUERIES[name](spark, small_dir).toPandas()
    assert difference(got, con.execute(SQL[name]).df()) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, small_dir, name):
    assert QUERIES[name](spark, small_dir).limit(1).count() == 1


def test_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    out = driver.entry(spark)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert out.count() == 400
