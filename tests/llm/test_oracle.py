import pytest

import __spark_entry__ as entry
from kelpline.llm import queries
from tests.oracle import compare, duck


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_agrees_with_sql(spark, sf, con, name):
    compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], sf)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_runs(spark, sf, name):
    assert entry.queries()[name](spark, sf).count() >= 1
