"""Queries that SQL can express, on whole tables."""

import pytest

from stackwave.llm.queries import QUERIES, SQL

from ..compare import connection, differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    assert not differences(QUERIES[name](spark, SF), SQL[name], connection(SF))
