"""Every named query against its SQL on the smallest tables; those without SQL must give rows of a stable schema."""

import pytest

from conftest import DATA, same_as_sql
from meridian.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, duck, name):
    same_as_sql(spark, duck, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    a, b = QUERIES[name](spark, DATA), QUERIES[name](spark, DATA)
    assert a.schema == b.schema
    assert a.count() == b.count()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
