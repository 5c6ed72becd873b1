import pytest

import __spark_entry__ as entry
from tessera.plans import registry
from tests.oracle import connect, same


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.SQL)
    assert len(registry.QUERIES) > 50


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, small, con, name):
    same(registry.QUERIES[name](spark, small), con, registry.SQL[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
