"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_equals_sql(spark, con, name):
    sql = entry.oracle_sql().get(name)
    diff = compare(spark, con, name, entry.queries()[name], sql, SF_DIR)
    assert diff is None or diff == "no rows", diff


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
