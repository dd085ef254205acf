"""Every core query that has SQL gives the same rows as DuckDB; the others run and keep their schema."""

import pytest
from oracle import assert_equal, connect

from grainfold import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, con, name):
    df = QUERIES[name](spark, data)
    if name in SQL:
        assert_equal(con, df, SQL[name])
    else:
        df.collect()
        assert df.columns
