"""Every query against its SQL on the smallest tables."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb
import pytest

from millrace.oracles import ORACLE_SQL
from millrace.queries import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
#: One of each kind; all run under MILLRACE_ALL=1 and in the driver's comparison.
SOME = [
    "revenue_by_region_channel", "category_return_rate", "curated_sales_lines", "conform_batch_orders", "conform_silver_payments", "conform_valid", "gold_daily", "gold_store_region", "margin_last30", "dim_date",
    "surrogate_keys_incremental", "scd1_merge", "upsert_merge", "scd2_incremental", "scd2_recovery", "fact_sales_pit", "star_sales_by_tier", "quality_scd2", "merge_read", "history_ops", "ingest_pending_files", "pit_versions",
    "gold_category_refreshed", "change_feed", "named_read", "redelivered_snapshot",
    "silver_from_landing", "silver_merge_customers",
]


def plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (int, float, decimal.Decimal)):
        return "nan" if isinstance(value, float) and math.isnan(value) else f"{float(value):.6g}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for f in os.listdir(DATA):
        con.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES) if os.environ.get("MILLRACE_ALL") else SOME)
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    cols = sorted(df.columns)
    a = sorted([plain(v) for v in r] for r in df.select(*cols).collect())
    b = sorted([plain(v) for v in r] for r in want.select(*cols).fetchall())
    assert a == b
