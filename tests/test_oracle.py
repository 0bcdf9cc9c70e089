"""A spread of registered queries against their SQL on the smallest data set.

Set BARLOOM_ALL=1 to compare every query.
"""

import os

import pytest

import __spark_entry__ as entry
from check_oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
SAMPLE = ["i2_screener_flag", "e13_ema", "e5_rsi", "e21_cross_sectional_rank", "i10_long_short_position", "m1_rsi_rotation", "n2_six_regimes",
          "b14_filter_chain", "c6_execution_price", "d6_performance", "d12_value_at_risk", "p3_inverse_volatility", "v11_grid_sweep", "a2_normalise", "h7_edge_score"]
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF_DIR):
        pytest.skip("test data not present")
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES) if os.environ.get("BARLOOM_ALL") else SAMPLE)
def test_query(spark, con, name):
    ok, note = compare(spark, con, SF_DIR, name, QUERIES[name], SQL.get(name))
    assert ok, note


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert {q for q in set(QUERIES) - set(SQL) if q != "pipeline" and not q.startswith("op")} == {"p7_kelly"}


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 6 and "signal" in df.columns
