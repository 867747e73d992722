"""The six KPI tables. Money stays decimal; what has no activity has typed zeros."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.expr import zero_if_null

#: What Spark makes of a sum of decimal(10,2).
_SUM = "decimal(20,2)"


def _ratio(top: Column, bottom: Column, times: int = 1) -> Column:
    """Exact quotient rounded half up to two places, 0 where there is nothing to divide by."""
    money = "decimal(18,2)"
    return F.coalesce(F.try_divide((top * times).cast(money), bottom).cast(money), F.lit(0).cast(money))


def _returns_with_order(returns: DataFrame, items: DataFrame, orders: DataFrame) -> DataFrame:
    return returns.join(items.select("order_item_id", "order_id"), "order_item_id").join(orders.select("order_id", "order_date"), "order_id")


def _orders_with_lines(orders: DataFrame, items: DataFrame, **sums: str) -> DataFrame:
    """``orders`` that have lines, with sums of these; lines are shuffled once and are few when they meet their order.

    All shuffle partitions are kept, as orders summed in memory take several times the room of their shuffled lines.
    """
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = items.select("order_id", *sums.values()).repartition(parts, "order_id")
    return lines.groupBy("order_id").agg(*(F.sum(c).alias(name) for name, c in sums.items())).join(orders, "order_id")


def daily_sales(orders: DataFrame, items: DataFrame, products: DataFrame, returns: DataFrame) -> DataFrame:
    """By order date, all statuses; returns count for the date of their order."""
    lines = items.join(orders.select("order_id", "order_date"), "order_id").join(products.select("product_id", "cost_price"), "product_id")
    sales = lines.groupBy("order_date").agg(
        F.count_distinct("order_id").alias("total_orders"),
        F.sum("quantity").alias("total_units_sold"),
        F.sum(F.col("quantity") * F.col("unit_price")).alias("gross_revenue"),
        F.sum("discount_amount").alias("total_discounts"),
        F.sum("net_amount").alias("net_sales"),
        F.sum(F.col("quantity") * F.col("cost_price")).alias("total_cogs"),
    )
    back = _returns_with_order(returns, items, orders).groupBy("order_date").agg(F.count("return_id").alias("returns_count"), F.sum("refund_amount").alias("total_refunded_amount"))
    return sales.join(back, "order_date", "left").select(
        *sales.columns,
        (F.col("net_sales") - F.col("total_cogs")).alias("gross_profit"),
        F.coalesce("returns_count", F.lit(0)).alias("returns_count"),
        zero_if_null("total_refunded_amount").alias("total_refunded_amount"),
    )


def monthly_revenue(orders: DataFrame, items: DataFrame, returns: DataFrame) -> DataFrame:
    """By year and month of the order date."""
    month = {"year": F.year("order_date"), "month": F.month("order_date")}
    sales = _orders_with_lines(orders.select("order_id", "order_date"), items, _units="quantity", _net="net_amount").withColumns(month)
    sales = sales.groupBy("year", "month").agg(F.count_distinct("order_id").alias("total_orders"), F.sum("_units").alias("total_units_sold"), F.sum("_net").cast(_SUM).alias("total_net_revenue"))
    back = _returns_with_order(returns, items, orders).withColumns(month).groupBy("year", "month").agg(F.sum("refund_amount").alias("total_refunded_amount"))
    return sales.join(back, ["year", "month"], "left").withColumn("total_refunded_amount", zero_if_null("total_refunded_amount"))


def store_revenue(orders: DataFrame, items: DataFrame, stores: DataFrame) -> DataFrame:
    """Every store, with zeros for one that sold nothing."""
    sold = _orders_with_lines(orders.select("order_id", "store_id"), items, _net="net_amount")
    sales = sold.groupBy("store_id").agg(F.count_distinct("order_id").alias("total_orders"), F.sum("_net").cast(_SUM).alias("total_net_revenue"))
    out = stores.select("store_id", "store_name", "store_type", "region", "state", "country").join(sales, "store_id", "left")
    out = out.withColumns({"total_orders": F.coalesce("total_orders", F.lit(0)), "total_net_revenue": zero_if_null("total_net_revenue")})
    return out.withColumn("avg_order_value", _ratio(F.col("total_net_revenue"), F.col("total_orders")))


def category_performance(items: DataFrame, products: DataFrame, returns: DataFrame) -> DataFrame:
    """By category and subcategory; ``units_returned`` counts return events."""
    by = ["category", "subcategory"]
    kinds = products.select("product_id", *by)
    sales = (
        items.join(kinds, "product_id")
        .groupBy(*by)
        .agg(
            F.sum("quantity").alias("units_sold"),
            F.sum(F.col("quantity") * F.col("unit_price")).alias("gross_revenue"),
            F.sum("discount_amount").alias("total_discounts"),
            F.sum("net_amount").alias("net_revenue"),
        )
    )
    back = returns.join(items.select("order_item_id", "product_id"), "order_item_id").join(kinds, "product_id").groupBy(*by).agg(F.count("return_id").alias("units_returned"), F.sum("refund_amount").alias("total_refunded_amount"))
    out = sales.join(back, by, "left").withColumns({"units_returned": F.coalesce("units_returned", F.lit(0)), "total_refunded_amount": zero_if_null("total_refunded_amount")})
    return out.withColumn("return_rate_pct", _ratio(F.col("units_returned"), F.col("units_sold"), 100))


def customer_spending(customers: DataFrame, orders: DataFrame, items: DataFrame) -> DataFrame:
    """Every customer, with zeros and no dates for one without orders."""
    spend = (
        _orders_with_lines(orders.select("order_id", "customer_id", "order_date"), items, _net="net_amount")
        .groupBy("customer_id")
        .agg(F.count_distinct("order_id").alias("total_orders"), F.sum("_net").cast(_SUM).alias("lifetime_spend"), F.min("order_date").alias("first_order_date"), F.max("order_date").alias("latest_order_date"))
    )
    out = customers.select("customer_id", "first_name", "last_name", "email", "loyalty_tier").join(spend, "customer_id", "left")
    out = out.withColumns({"total_orders": F.coalesce("total_orders", F.lit(0)), "lifetime_spend": zero_if_null("lifetime_spend")})
    return out.withColumn("avg_order_value", _ratio(F.col("lifetime_spend"), F.col("total_orders")))


def return_reasons(returns: DataFrame) -> DataFrame:
    """Count, sum and average (two places) of refunds by reason."""
    return returns.groupBy("return_reason").agg(
        F.count("return_id").alias("return_count"),
        F.sum("refund_amount").alias("total_refund_amount"),
        F.round(F.avg("refund_amount"), 2).alias("avg_refund_amount"),
    )


#: Table name -> builder over the layer's tables by name.
KPI = {
    "gold_daily_sales_performance": lambda t: daily_sales(t["orders"], t["order_items"], t["products"], t["returns"]),
    "gold_monthly_revenue": lambda t: monthly_revenue(t["orders"], t["order_items"], t["returns"]),
    "gold_revenue_by_store_region": lambda t: store_revenue(t["orders"], t["order_items"], t["stores"]),
    "gold_category_revenue_performance": lambda t: category_performance(t["order_items"], t["products"], t["returns"]),
    "gold_customer_spending_summary": lambda t: customer_spending(t["customers"], t["orders"], t["order_items"]),
    "gold_return_refund_performance": lambda t: return_reasons(t["returns"]),
}
