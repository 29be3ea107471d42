"""Every query with SQL against DuckDB on the smallest tables, and every query without: it runs and has the columns it says."""

import pytest
from oracle import connect, differences

from corpus.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows_as_sql(spark, duck, name):
    assert not differences(registry.QUERIES[name](spark, SF), duck.execute(registry.SQL[name]))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_has_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(entry.queries()) and set(registry.SQL) <= set(entry.oracle_sql())
