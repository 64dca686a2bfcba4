"""Every registered query with SQL gives the same rows as DuckDB."""

import pytest

from ledgerlens.plans.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(name, spark, data, duck, same_rows):
    same_rows(QUERIES[name](spark, data).toPandas(), duck.sql(ORACLES[name]).df())


def test_all_queries_have_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
