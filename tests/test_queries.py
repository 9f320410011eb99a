"""Every named query against its SQL in another engine."""

from __future__ import annotations

import pytest

from stackwave.queries import QUERIES, SQL

from .compare import connection, differences

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, name):
    found = differences(QUERIES[name](spark, SF), SQL[name], con)
    if found == ["no rows"]:  # the smallest tables have no pixel there
        found = differences(QUERIES[name](spark, LARGER), SQL[name], connection(LARGER))
    assert not found, found


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_module():
    import __spark_entry__

    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and set(QUERIES) <= set(queries)
