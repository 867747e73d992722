"""Customers and products whose ids are cut to six digits, so that several share one, as beyond a million of them: results against SQL."""

from __future__ import annotations

import os

import duckdb
import pytest
from test_queries import DATA, plain, pytestmark  # noqa: F401

from millrace.oracles import ORACLE_SQL
from millrace.queries import QUERIES

MOVED = {"part": "p_partkey", "lineitem": "l_partkey", "customer": "c_custkey", "orders": "o_custkey"}


@pytest.fixture(scope="module")
def shared(tmp_path_factory):
    """Twenty customers and parts have six digits, the others seven: ids of up to eleven are one."""
    at, con = tmp_path_factory.mktemp("shared"), duckdb.connect()
    con.sql("set timezone='UTC'")
    for f in os.listdir(DATA):
        name = f.split(".")[0]
        key = MOVED.get(name)
        change = f"replace (case when {key} < 20 then 100000 + {key} else 999980 + {key} end as {key})" if key else ""
        con.sql(f"copy (select * {change} from '{DATA}/{f}') to '{at}/{f}' (format parquet)")
        con.sql(f"create view {name} as select * from '{at}/{f}'")
    return str(at), con


def both(spark, shared, name):
    df, want = QUERIES[name](spark, shared[0]), shared[1].sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    cols = sorted(df.columns)
    return tuple(sorted([plain(v) for v in r] for r in rows) for rows in (df.select(*cols).collect(), want.select(*cols).fetchall()))


@pytest.mark.parametrize("name", ["gold_customer_refreshed", "quality_unknown", "quality_uniqueness", "quality_completeness", "quality_ri", "quality_measures", "star_category_profit"])
def test_query_matches_sql(spark, shared, name):
    got, want = both(spark, shared, name)
    assert got == want


def test_gate_log_matches_sql_but_for_what_it_leaves_open(spark, shared):
    """Which of the versions that begin together comes first is open in the SQL, and with it how many overlap: at most one for each id."""
    got, want = both(spark, shared, "quality_gate_log")
    near = [[next(r for r in rows if r[0] == "scd2_no_overlap") for rows in (got, want)]]
    assert [r for r in got if r[0] != "scd2_no_overlap"] == [r for r in want if r[0] != "scd2_no_overlap"]
    assert all(abs(float(a[2]) - float(b[2])) <= 13 for a, b in near)
