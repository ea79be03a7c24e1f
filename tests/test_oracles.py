"""Every query that has SQL against it, over the whole small tables."""

import pytest

from sigspark.queries import ORACLE_SQL, QUERIES

from conftest import SF
from oracle import connect, difference


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SF), con, ORACLE_SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert not QUERIES[name](spark, SF).isEmpty()
