"""Every query with SQL must give the same whole result in DuckDB on the same files."""

import parity
import pytest

from tabulens import suite

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = suite.queries(), suite.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return parity.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_result(spark, duck, name):
    assert parity.compare(QUERIES[name](spark, SF_DIR), duck, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0
