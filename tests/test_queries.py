"""Every registered query that has SQL, against DuckDB on the smallest tables."""

import pytest
from compare import connect, differences
from conftest import SF

import __spark_entry__ as entry

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = connect(SF)
    yield c
    c.close()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    assert differences(entry.queries()[name](spark, SF), con, SQL[name]) == []
