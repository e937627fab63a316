"""Every registered query with SQL agrees with it, on the smallest data; the others give rows."""

import pytest

import __spark_entry__ as entry
from kelpline import catalog
from tests.oracle import compare, duck


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_agrees_with_sql(spark, sf, con, name):
    compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], sf)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(spark, sf, name):
    assert entry.queries()[name](spark, sf).count() >= 1


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "vec_id", "distance", "rank"]
