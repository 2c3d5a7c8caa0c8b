"""Every registered query against its DuckDB restatement (the driver's correctness gate, run locally).

Runs at sf0.001 by default; ``ROOMTRACE_ORACLE_SF`` switches the directory.
"""

import os

import pytest

import __spark_entry__ as E
from roomtrace.plans import catalog
from tools.oracle_check import compare, duck_con

SF = os.environ.get("ROOMTRACE_ORACLE_SF", "/root/testdata/sf0.001")
E.queries()
QUERIES, SQL = catalog.QUERIES, catalog.SQL


@pytest.fixture(scope="module")
def con():
    return duck_con(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, QUERIES[name], SQL[name], SF)
    assert r["status"] == "ok", r


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert {"device_id", "hour_ts", "light", "rows"} <= set(df.columns)
