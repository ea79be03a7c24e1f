"""Queries with SQL against it."""

import pytest

from sigspark.llm.queries import ORACLE_SQL, QUERIES

from oracle import connect, difference

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert difference(QUERIES[name](spark, SF), connect(SF), ORACLE_SQL[name]) is None
