import pytest
from helpers import compare_with_duckdb

from taskloom.plans import catalog, service  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, name):
    compare_with_duckdb(spark, catalog.queries()[name], catalog.oracle_sql()[name], SF)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
