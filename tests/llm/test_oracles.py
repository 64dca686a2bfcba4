import pytest

from ledgerlens.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows_as_sql(name, spark, data, duck, same_rows):
    same_rows(queries()[name](spark, data).toPandas(), duck.sql(oracle_sql()[name]).df())
