"""Every registered query against its SQL twin."""

import pytest

from chargelake import queries as sessions

from .oracle import assert_same

SF = "/root/testdata/sf0.001"
SQL = sessions.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert_same(spark, sessions.queries()[name], SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(sessions.queries()) - set(SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert sessions.queries()[name](spark, SF).count() > 0
