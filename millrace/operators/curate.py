"""Curated sales: order lines with their order, product, customer and store, exact amounts and order-grain windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.expr import narrowed
from millrace.operators.blocks import dense_ranks, running
from millrace.operators.keys import RANGE_ROWS
from millrace.session import reliable

#: What is summed of the lines of an order.
ORDER_SUMS = ("quantity", "gross_sales", "discount_amount", "net_sales")


def _step(c: Column) -> Column:
    """Every amount is rounded half up to cents when it is derived."""
    return narrowed(c, 12, 2)


def _net(lines: DataFrame) -> DataFrame:
    lines = lines.withColumn("discount_amount", _step(F.col("gross_sales") * F.col("discount_percent")))
    return lines.withColumn("net_sales", _step(F.col("gross_sales") - F.col("discount_amount")))


def sales_lines(orders: DataFrame, items: DataFrame, products: DataFrame, customers: DataFrame, stores: DataFrame) -> DataFrame:
    """Lines of validated orders: gross, discount, net, cost and profit, and the order's date parts."""
    units = F.col("quantity").cast("decimal(12,2)")
    lines = (
        items.join(orders.select("order_id", "customer_id", "store_id", "employee_id", "order_timestamp", "order_date", "order_status", "channel"), "order_id")
        .join(products.select("product_id", "product_sku", "product_name", "category", "subcategory", "cost_price"), "product_id")
        .join(customers.select("customer_id", F.col("full_name").alias("customer_name"), F.col("email").alias("customer_email"), F.col("state").alias("customer_state"), "loyalty_tier"), "customer_id")
        .join(stores.select("store_id", "store_name", "store_type", F.col("region").alias("store_region"), F.col("state").alias("store_state")), "store_id")
    )
    lines = lines.withColumns({"gross_sales": _step(units * F.col("unit_price")), "cost_amount": _step(units * F.col("cost_price"))})
    lines = _net(lines)
    return lines.withColumns(
        {
            "gross_profit": _step(F.col("net_sales") - F.col("cost_amount")),
            "order_year": F.year("order_date"),
            "order_month": F.month("order_date"),
            "order_day": F.dayofmonth("order_date"),
        }
    )


def order_metrics(lines: DataFrame, orders: DataFrame | None = None, rows: int = RANGE_ROWS) -> DataFrame:
    """(customer_id, order_id): sequence of the customer's orders, days since the one before, running spend.

    A customer of over ``rows`` orders, as ``orders`` counts them, is worked on in blocks of time.
    """
    totals = lines.groupBy("customer_id", "order_id", "order_timestamp", "order_date").agg(F.sum("net_sales").alias("spend"))
    found = running(totals, ["customer_id"], "order_timestamp", ["order_id"], "customer_order_sequence", {"_spent": "spend"}, {"_prior": "order_date"}, rows, orders)
    return found.select("customer_id", "order_id", "customer_order_sequence", F.datediff("order_date", "_prior").alias("days_since_prior_order"), F.col("_spent").cast("decimal(14,2)").alias("customer_running_spend"))


def summed_by_order(lines: DataFrame) -> DataFrame:
    """``sales_lines`` summed for each order; ``n_net`` is how many lines have net sales."""
    return lines.groupBy("order_id", "customer_id", "order_date").agg(*(F.sum(c).alias(c) for c in ORDER_SUMS), F.count("net_sales").alias("n_net"))


def order_totals(orders: DataFrame, items: DataFrame, products: DataFrame, customers: DataFrame, stores: DataFrame) -> DataFrame:
    """What ``summed_by_order`` makes of ``sales_lines``, without these.

    Products, customers and stores are counted by id: those that share one multiply sums and make no more rows. All shuffle
    partitions are kept, as orders summed in memory take several times the room of their shuffled lines.
    """

    def counted(df: DataFrame, key: str, name: str) -> DataFrame:
        return df.groupBy(key).agg(F.count("*").alias(name))

    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = items.select("order_id", "product_id", "quantity", "unit_price", "discount_percent").join(counted(products, "product_id", "_n"), "product_id")
    lines = lines.select("order_id", "quantity", "unit_price", "discount_percent", F.col("_n").cast("int").alias("_n")).repartition(parts, "order_id")
    lines = _net(lines.withColumn("gross_sales", _step(F.col("quantity").cast("decimal(12,2)") * F.col("unit_price"))))
    each = lines.groupBy("order_id").agg(*(F.sum(F.col(c) * F.col("_n")).alias(c) for c in ORDER_SUMS), F.sum(F.when(F.col("net_sales").isNotNull(), F.col("_n")).otherwise(0)).alias("n_net"))
    known = orders.select("order_id", "customer_id", "store_id", "order_date").join(counted(customers, "customer_id", "_c"), "customer_id").join(counted(stores, "store_id", "_s"), "store_id")
    times = F.col("_c") * F.col("_s")
    return each.join(known, "order_id").select("order_id", "customer_id", "order_date", *((F.col(c) * times).alias(c) for c in (*ORDER_SUMS, "n_net")))


def product_totals(orders: DataFrame, items: DataFrame, products: DataFrame, customers: DataFrame, stores: DataFrame) -> DataFrame:
    """(category, product_id, _total): net sales as ``sales_lines`` has them.

    Orders meet customers and stores before lines meet orders, and lines are summed by product_id before they meet products,
    so that lines are shuffled once for their order and products that share an id make no more lines.
    """
    known = orders.select("order_id", "customer_id", "store_id").join(customers.select("customer_id"), "customer_id").join(stores.select("store_id"), "store_id")
    lines = items.select("order_id", "product_id", "quantity", "unit_price", "discount_percent").join(known.select("order_id"), "order_id")
    lines = _net(lines.withColumn("gross_sales", _step(F.col("quantity").cast("decimal(12,2)") * F.col("unit_price"))))
    sold = lines.groupBy("product_id").agg(F.sum("net_sales").alias("_sold"))
    return sold.join(products.select("product_id", "category"), "product_id").groupBy("category", "product_id").agg(F.sum("_sold").alias("_total"))


def product_ranks(totals: DataFrame, products: DataFrame | None = None, rows: int = RANGE_ROWS) -> DataFrame:
    """(category, product_id, category_product_rank) by the net sales of ``product_totals``; ties share a rank. ``products`` counts those of a category."""
    totals = reliable(totals)  # a row for each product, which ranks and the rows they go to both read
    return dense_ranks(totals, ["category"], "_total", "category_product_rank", True, rows, products).drop("_total")


def curated_sales(orders: DataFrame, items: DataFrame, products: DataFrame, customers: DataFrame, stores: DataFrame) -> DataFrame:
    """``sales_lines`` with order metrics and product ranks brought back to each line."""
    lines = sales_lines(orders, items, products, customers, stores)
    return lines.join(order_metrics(lines, orders), ["customer_id", "order_id"]).join(product_ranks(product_totals(orders, items, products, customers, stores), products), ["category", "product_id"], "left")
