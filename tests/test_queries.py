"""Every registered query against its SQL, on the smallest data set; the rest must give rows."""

import pytest

from tests.duck import ORACLES, QUERIES, connect, duck_rows, spark_rows

@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf_dir, con, name):
    assert spark_rows(spark, sf_dir, name) == duck_rows(con, name)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, sf_dir, name):
    assert spark_rows(spark, sf_dir, name)[1]


def test_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())
    assert e.entry(spark).columns
