"""Lines are summed by order before days count orders and customers; what comes out is as if every line had been there."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from millrace.operators.curate import ORDER_SUMS, order_totals, sales_lines, summed_by_order
from millrace.plans.serving import REPORTS
from millrace.queries import QUERIES
from millrace.session import sql_over
from test_cut_ids import both, pytestmark, wide  # noqa: F401


def retail(spark):
    """Ids of products, customers and stores that several rows share, orders and lines that meet nothing, and missing amounts."""
    orders = spark.sql("select order_id, customer_id, store_id, 'E' as employee_id, timestamp'2024-01-01 00:00:00' as order_timestamp, d as order_date, 'PENDING' as order_status, 'WEB' as channel from values ('O1', 'C1', 'S1', date'2024-01-01'), ('O2', 'C2', 'S2', date'2024-01-01'), ('O3', 'C9', 'S1', date'2024-01-01'), ('O4', 'C1', 'S1', date'2024-01-02'), ('O5', 'C1', null, date'2024-01-02') as t(order_id, customer_id, store_id, d)")
    items = spark.sql("select concat('i', n) as order_item_id, order_id, product_id, q as quantity, cast(p as decimal(10,2)) as unit_price, cast(d as decimal(5,2)) as discount_percent from values (1, 'O1', 'P1', 2, 1.15, 0.10), (2, 'O1', 'P2', 1, 0.05, 0.50), (3, 'O2', 'P1', 3, 2.00, null), (4, 'O2', 'P2', 1, 4.00, 0.00), (5, 'O3', 'P1', 1, 1.00, 0.00), (6, 'O4', 'P9', 1, 1.00, 0.00), (7, 'O4', 'P2', null, 1.00, 0.00), (8, 'O5', 'P1', 1, 1.00, 0.00), (9, 'O9', 'P1', 1, 1.00, 0.00) as t(n, order_id, product_id, q, p, d)")
    products = spark.sql("select product_id, 's' as product_sku, 'n' as product_name, 'c' as category, 'u' as subcategory, cast(c as decimal(10,2)) as cost_price from values ('P1', 1), ('P1', 2), ('P1', 3), ('P2', 1), (null, 1) as t(product_id, c)")
    customers = spark.sql("select customer_id, 'n' as full_name, 'e' as email, 's' as state, 'GOLD' as loyalty_tier from values ('C1'), ('C2'), ('C2') as t(customer_id)")
    stores = spark.sql("select store_id, 'n' as store_name, 't' as store_type, 'r' as region, 's' as state from values ('S1'), ('S2'), ('S2') as t(store_id)")
    return orders, items, products, customers, stores


def test_order_totals_are_the_sums_of_the_lines(spark):
    cols = ["order_id", "customer_id", "order_date", *ORDER_SUMS, "n_net"]
    got, want = (sorted(map(str, df.select(*cols).collect())) for df in (order_totals(*retail(spark)), summed_by_order(sales_lines(*retail(spark)))))
    assert got == want and len(got) == 3


def test_daily_revenue_sums_lines_by_order_before_it_counts(spark, wide):  # noqa: F811
    got, want = both(spark, wide, "daily_revenue")
    assert got == want
    plan = QUERIES["daily_revenue"](spark, wide[0])._jdf.queryExecution().optimizedPlan().toString().splitlines()
    expand = next(k for k, line in enumerate(plan) if "Expand" in line)
    assert any("Aggregate [order_id" in line for line in plan[expand:])


def test_daily_revenue_beyond_ten_to_the_twelfth_and_an_average_just_below_half_a_cent(spark):
    day = spark.range(300).select(F.concat(F.lit("O"), "id").alias("order_id"), F.lit("C").alias("customer_id"), F.lit("2024-01-01").cast("date").alias("order_date"), F.lit(1).alias("quantity"), *(F.lit(Decimal("9999999999.99")).alias(c) for c in ("gross_sales", "discount_amount", "net_sales")), F.lit(10**6).alias("n_net"))
    [row] = sql_over(spark, {"v_order_totals": day}, REPORTS["daily_revenue"]).collect()
    assert (row.total_orders, row.unique_customers, row.total_net_revenue, row.avg_line_item_value) == (300, 1, 300 * Decimal("9999999999.99"), Decimal("10000.00"))
    low = day.limit(1).withColumns({"net_sales": F.lit(Decimal("14999.99")), "n_net": F.lit(3 * 10**6)})
    assert sql_over(spark, {"v_order_totals": low}, REPORTS["daily_revenue"]).first().avg_line_item_value == 0
