"""Every query with SQL, in Spark and in DuckDB, on the smallest tables."""

from pathlib import Path

import pytest
from oracle_check import compare, duck

from __spark_entry__ import entry, oracle_sql, queries

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, con, name):
    ok, text = compare(spark, con, SF_DIR, name, queries()[name], oracle_sql()[name])
    assert ok, text


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0
