"""Facts summed by order for reports that ask for no product; what comes out is as if every line had met its products and customer."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from test_cut_ids import both, pytestmark, wide  # noqa: F401

from millrace.operators import dimensions as dims
from millrace.queries import QUERIES

AMOUNTS = ("quantity", "gross_amount", "discount_amount", "net_amount", "cost_amount", "profit_amount")


def test_sales_by_order_are_the_sums_of_the_facts(spark):
    items = spark.sql("select concat('i', n) as order_item_id, order_id, product_id, q as quantity, cast(p as decimal(10,2)) as unit_price, cast(0.10 as decimal(10,2)) as discount_amount, cast(net as decimal(10,2)) as net_amount from values (1, 'O1', 'P1', 2, 1.15, 2.20), (2, 'O1', 'P2', 1, 5.00, 4.90), (3, 'O2', 'P9', 3, 2.00, 5.90), (4, 'O2', null, 1, 4.00, 3.90), (5, 'O3', 'P1', null, 1.00, 1.00), (6, 'O3', 'P1', 1, 1.00, null), (7, 'O4', 'P1', 1, 1.00, 0.90), (8, 'O9', 'P1', 1, 1.00, 0.90) as t(n, order_id, product_id, q, p, net)")
    orders = spark.sql("select order_id, customer_id, store_id, ts as order_timestamp, cast(ts as date) as order_date, 'WEB' as channel, 'PENDING' as order_status from values ('O1', 'C1', 'S1', timestamp'2024-01-01 10:00:00'), ('O2', 'C1', 'S2', timestamp'2024-02-01 10:00:00'), ('O3', 'C9', 'S9', timestamp'2030-01-01 10:00:00'), ('O4', null, null, null) as t(order_id, customer_id, store_id, ts)")
    products = spark.sql("select product_id, k as product_key, cast(c as decimal(10,2)) as cost_price from values ('P1', 1, 1.50), ('P1', 2, 0.25), ('P1', 3, null), ('P2', 4, 2.00) as t(product_id, k, c)")
    customers = spark.sql("select 'C1' as customer_id, k as customer_key, a as effective_from, b as effective_to from values (1, timestamp'2020-01-01 00:00:00', timestamp'2024-01-15 00:00:00'), (2, timestamp'2024-01-15 00:00:00', null) as t(k, a, b)")
    stores = spark.sql("select * from values ('S1', 1), ('S2', 2), ('S2', 3) as t(store_id, store_key)")
    given = (items, orders, customers, products, stores, dims.dim_date(spark, "2024-01-01", "2024-12-31"))
    by = ["order_id", "customer_key", "store_key", "order_date_key"]
    want = dims.fact_sales(*given).groupBy(*by).agg(*(F.sum(c).alias(c) for c in AMOUNTS)).select(*by, *AMOUNTS)
    got = dims.sales_by_order(*given).select(*by, *AMOUNTS)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.count() == 5


@pytest.mark.parametrize("name", ["star_sales_by_tier", "star_store_month"])
def test_star_reports_without_a_product_sum_lines_by_order(spark, wide, name):  # noqa: F811
    got, want = both(spark, wide, name)
    assert got == want
    plan = QUERIES[name](spark, wide[0])._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert any("Aggregate [order_id#" in line and "sum" in line for line in plan)
