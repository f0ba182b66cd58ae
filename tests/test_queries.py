"""Every registered query against its SQL on whole tables, and the driver contract."""

import pytest
from oracle_check import compare, duck

import __spark_entry__ as entry
from reviewflow import plans

# The training-data queries have tests of their own beside their operators.
QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return duck(small)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, small, name):
    _, _, verdict = compare(spark, con, small, QUERIES[name], SQL[name])
    assert verdict == "ok"


def test_entry(spark):
    assert entry.entry(spark).columns == ["node_name", "executions", "avg_duration", "successful",
                                          "failed"]


def test_every_query_is_registered_with_sql():
    assert set(SQL) == set(QUERIES) <= set(entry.queries())
    assert set(SQL) <= set(entry.oracle_sql()) <= set(entry.queries())
