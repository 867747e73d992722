"""Products whose ids are cut to six digits, so that several share one, as beyond a million parts: results against SQL."""

from __future__ import annotations

import os

import duckdb
import pytest
from test_queries import plain

from millrace.oracles import ORACLE_SQL
from millrace.queries import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
#: Which of the rows that share an id gets which key is open in the SQL, and with it what a key stands for.
OPEN = {"product_key", "product_sku", "product_name", "category", "subcategory", "cost_price", "unit_price", "is_active", "cost_amount", "profit_amount"}


@pytest.fixture(scope="module")
def wide(tmp_path_factory):
    """Twenty parts have six digits, the others seven: ids of up to eleven are one."""
    at, con = tmp_path_factory.mktemp("wide"), duckdb.connect()
    con.sql("set timezone='UTC'")
    moved = {"part": "p_partkey", "lineitem": "l_partkey"}
    for f in os.listdir(DATA):
        name = f.split(".")[0]
        key = moved.get(name)
        change = f"replace (case when {key} < 20 then 100000 + {key} else 1000000 + {key} end as {key})" if key else ""
        con.sql(f"copy (select * {change} from '{DATA}/{f}') to '{at}/{f}' (format parquet)")
        con.sql(f"create view {name} as select * from '{at}/{f}'")
    return str(at), con


def both(spark, wide, name, leave=frozenset()):
    df, want = QUERIES[name](spark, wide[0]), wide[1].sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    cols = sorted(set(df.columns) - leave)
    return tuple(sorted([plain(v) for v in r] for r in rows) for rows in (df.select(*cols).collect(), want.select(*cols).fetchall()))


@pytest.mark.parametrize("name", ["gold_category_refreshed", "gold_daily_refreshed", "fact_returns", "quality_uniqueness", "star_category_profit", "star_return_rate"])
def test_query_matches_sql(spark, wide, name):
    got, want = both(spark, wide, name)
    assert got == want


@pytest.mark.parametrize("name", ["fact_upsert_rerun", "dim_product"])
def test_rows_match_sql_but_for_what_it_leaves_open(spark, wide, name):
    got, want = both(spark, wide, name, OPEN - {"product_key"})
    assert got == want


def test_type1_gives_each_row_that_shares_an_id_a_key(spark, wide):
    got, want = both(spark, wide, "scd1_merge", frozenset({"unit_price"}))
    assert got == want


@pytest.mark.parametrize("name", ["category_product_rank", "curated_sales_lines"])
def test_ranks_match_sql(spark, wide, name):
    got, want = both(spark, wide, name)
    assert got == want


def test_lines_are_summed_before_they_meet_products(spark, wide):
    plan = QUERIES["category_product_rank"](spark, wide[0])._jdf.queryExecution().optimizedPlan().toString()
    assert any("Aggregate [product_id" in line for line in plan.splitlines())
