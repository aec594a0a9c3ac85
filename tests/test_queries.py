"""Registered queries against their DuckDB SQL on the smallest tables; `python tests/oracle.py sf0.01` runs all of them."""
import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
NAMES = [n for n in entry.oracle_sql() if n.startswith(("a1_", "a2_", "a18", "k3_", "k8", "d1_", "d4", "d8", "d10", "f1_", "f12", "j2_", "j5_", "j8_", "j10", "j13", "o1_", "p8_", "p16", "w2_", "w4_", "w11_c", "w13", "x4", "s3"))]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    assert compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) is None


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
