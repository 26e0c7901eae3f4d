"""Every query with SQL gives the rows that DuckDB gives."""

import pytest
from compare import same_rows
from conftest import SMALL

from quillspark.plans import registry

SQL = registry.oracle_sql()
QUERIES = registry.queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, name):
    same_rows(QUERIES[name](spark, SMALL), SQL[name], SMALL)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0
