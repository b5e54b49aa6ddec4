"""Every registered query against its SQL twin, on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from suite.check import compare, connect

SF_DIR = "/root/testdata/sf0.001"
SLOW = ("g14", "g15_cross", "g16", "g17")      # several fits each; covered by test_training


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", [n for n in queries() if not n.startswith(SLOW)])
def test_query(spark, con, name):
    ok, note = compare(spark, con, name, queries()[name], oracle_sql().get(name), SF_DIR)
    assert ok, note


def test_contract(spark):
    assert set(oracle_sql()) <= set(queries())
    row = entry(spark).first()
    assert 0 <= row["completeness"] <= 1 and 0 <= row["overall"] <= 100
