"""Lines are summed by order before they meet orders; what comes out is as if every line had met its own."""

from __future__ import annotations

from decimal import Decimal

from millrace.operators.kpi import customer_spending, monthly_revenue, store_revenue

D = Decimal


def test_lines_are_summed_before_they_meet_orders(spark):
    orders = spark.sql("select * from values ('O1', 'C1', 'S1', date'2024-01-31'), ('O1', 'C2', 'S1', date'2024-02-01'), ('O2', 'C1', null, null), ('O3', 'C1', 'S1', date'2024-01-02'), (null, 'C1', 'S1', date'2024-01-01') as t(order_id, customer_id, store_id, order_date)")
    items = spark.sql("select order_item_id, order_id, quantity, cast(net as decimal(10,2)) as net_amount from values ('a', 'O1', 2, 1.50), ('b', 'O1', null, 2), ('c', 'O2', 1, null), ('d', 'O9', 1, 1), ('e', null, 1, 1) as t(order_item_id, order_id, quantity, net)")
    customers = spark.sql("select customer_id, 'a' as first_name, 'b' as last_name, 'e' as email, 'GOLD' as loyalty_tier from values ('C1'), ('C2'), ('C3') as t(customer_id)")
    stores = spark.sql("select store_id, 'n' as store_name, 'm' as store_type, 'r' as region, 's' as state, 'US' as country from values ('S1'), ('S2') as t(store_id)")
    returns = spark.sql("select 'R1' as return_id, 'a' as order_item_id, cast(1 as decimal(10,2)) as refund_amount")
    # an order id that stands twice takes its lines twice
    months = monthly_revenue(orders, items, returns)
    assert sorted(map(tuple, months.collect()), key=str) == sorted([(2024, 1, 1, 2, D("3.50"), D(1)), (2024, 2, 1, 2, D("3.50"), D(1)), (None, None, 1, 1, None, D(0))], key=str)
    spent = {r.customer_id: (r.total_orders, r.lifetime_spend, r.avg_order_value) for r in customer_spending(customers, orders, items).collect()}
    assert spent == {"C1": (2, D("3.50"), D("1.75")), "C2": (1, D("3.50"), D("3.50")), "C3": (0, D(0), D(0))}
    sold = store_revenue(orders, items, stores)
    assert {r.store_id: (r.total_orders, r.total_net_revenue) for r in sold.collect()} == {"S1": (1, D("7.00")), "S2": (0, D(0))}
    for df in (months, sold):
        plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        assert any("Aggregate [order_id" in line for line in plan)
