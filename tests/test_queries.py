"""Every registered query against its DuckDB SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from compare import connect, difference

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, tables, name):
    frame = entry.queries()[name](spark, SF_DIR)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert frame.columns and frame.count() > 0
    else:
        assert difference(frame, tables, sql) is None


def test_entry(spark):
    assert entry.entry(spark).columns[:2] == ["key_df1", "key_df2"]


def test_no_oracle_without_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
