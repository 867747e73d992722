from __future__ import annotations

import decimal

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from millrace.operators import checks, dimensions as dims
from millrace.operators.keys import dense_numbers, surrogate_keys

D = decimal.Decimal
START = "2024-01-01 00:00:00"


def customers(spark, *rows):
    return spark.createDataFrame([(i, t) for i, t in rows], "customer_id string, loyalty_tier string").select(
        "customer_id", *(F.lit(None).cast("string").alias(c) for c in dims.PROFILE[1:10]), F.lit(None).cast("date").alias("signup_date"), "loyalty_tier"
    )


def versions(df):
    return sorted((r.customer_id, r.version_number, r.customer_key, r.loyalty_tier, r.is_current) for r in df.collect())


def test_keys_are_dense_and_stable(spark):
    s = lambda *ids: spark.createDataFrame([(i,) for i in ids], "store_id string")
    first = surrogate_keys(None, s("S-003", "S-001", "S-002", "S-001"), "store_id", "store_key")
    assert sorted(map(tuple, first.collect())) == [("S-001", 1), ("S-002", 2), ("S-003", 3)]
    assert sorted(map(tuple, surrogate_keys(first, s("S-002", "S-004"), "store_id", "store_key").collect())) == [("S-002", 2), ("S-004", 4)]


def test_dense_numbers_need_no_single_task(spark):
    df = dense_numbers(spark.range(1000).selectExpr("lpad(cast(999 - id as string), 4, '0') k"), "k", "n")
    assert [r.n for r in df.orderBy("k").collect()] == list(range(1, 1001))
    assert "Exchange SinglePartition" not in df.where("k > '5'").select("k")._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]


@pytest.mark.parametrize("parts", ["4", "211"])
def test_keys_of_many_rows_are_unique_dense_and_stable(spark, parts):
    """More rows than a range sampler takes, wide rows of which most columns are pruned, many ranges."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        wide = spark.range(0, 100_000, 1, 7).selectExpr("sha2(cast(id as string), 256) k", "id", *(f"repeat('{c}', 20) as c{c}" for c in "abcdef"))
        want = {r.k: n for n, r in enumerate(wide.select("k").orderBy("k").collect(), 11)}
        for rows in (2_000, 30_000):
            numbered = dense_numbers(wide, "k", "n", 11, rows)
            got = numbered.select("k", "n").collect()
            assert len(got) == 100_000 and dict(map(tuple, got)) == want
            assert numbered.agg(F.count_distinct("n"), F.min("n"), F.max("n")).first() == (100_000, 11, 100_010)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_numbers_of_nothing_and_of_null(spark):
    rows = spark.createDataFrame([("b",), (None,), ("a",)], "k string")
    assert sorted((r.n, r.k) for r in dense_numbers(rows, "k", "n").collect()) == [(1, None), (2, "a"), (3, "b")]
    assert dense_numbers(rows.where("false"), "k", "n").count() == 0


def test_calendar(spark):
    rows = dims.dim_date(spark, "2026-01-01", "2026-01-05").orderBy("date_key").collect()
    assert len(rows) == 6 and (rows[0].date_key, str(rows[0].full_date), rows[0].day_name) == (0, "1900-01-01", "Unknown")
    assert (rows[3].date_key, rows[3].day_of_week, rows[3].is_weekend, rows[3].quarter_name) == (20260103, 7, True, "Q1")
    assert dims.dim_date(spark).count() == 4019


def test_scd2_steps(spark):
    v1 = dims.scd2_initial(customers(spark, ("C1", "GOLD"), ("C2", "SILVER")), START)
    assert dims.scd2_apply(v1, customers(spark, ("C1", "GOLD"), ("C2", "SILVER")), "2024-06-01 00:00:00") is None
    v2 = dims.scd2_apply(v1, customers(spark, ("C1", "PLATINUM"), ("C3", "GOLD")), "2024-06-01 00:00:00")
    assert versions(v2) == [("C1", 1, 1, "GOLD", False), ("C1", 2, 4, "PLATINUM", True), ("C2", 1, 2, "SILVER", True), ("C3", 1, 3, "GOLD", True)]
    with pytest.raises(dims.TemporalOrderError):
        dims.scd2_apply(v2, customers(spark, ("C1", "GOLD")), "2024-06-01 00:00:00")
    with pytest.raises(dims.DuplicateKeyError):
        dims.scd2_apply(v2, customers(spark, ("C9", "GOLD"), ("C9", "SILVER")), "2025-01-01 00:00:00")


def test_scd2_recovers_a_closed_customer(spark):
    dim = dims.scd2_initial(customers(spark, ("C1", "GOLD")), START).withColumn("is_current", F.lit(False))
    assert versions(dims.scd2_apply(dim, customers(spark, ("C1", "GOLD")), "2024-06-01 00:00:00")) == [("C1", 1, 1, "GOLD", False), ("C1", 2, 2, "GOLD", True)]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.dictionaries(st.sampled_from("abc"), st.sampled_from(["GOLD", "SILVER"]), min_size=1), min_size=1, max_size=3))
def test_scd2_invariants_hold_after_any_batches(spark, batches):
    dim = dims.scd2_initial(customers(spark, *batches[0].items()), START)
    for n, b in enumerate(batches[1:], 1):
        dim = dims.scd2_apply(dim, customers(spark, *b.items()), f"2024-0{n + 1}-01 00:00:00") or dim
        dim = spark.createDataFrame(dim.collect(), dim.schema)
    assert all(r.passed for r in checks.suite(checks.scd2_invariants(dim), fail=False))


def star(spark, *, known=True):
    dim = dims.scd2_apply(dims.scd2_initial(customers(spark, ("C", "GOLD")), "2023-01-01 00:00:00"), customers(spark, ("C", "PLATINUM")), "2024-06-01 00:00:00")
    times = [("I1", "O1", "2024-03-15 10:00:00"), ("I2", "O2", "2024-08-20 10:00:00"), ("I3", "O3", "2024-06-01 00:00:00"), ("I4", "O4", "2023-10-01 00:00:00")]
    orders = spark.createDataFrame([(o, "C", "S", t, "WEB", "COMPLETED") for _, o, t in times], "order_id string, customer_id string, store_id string, t string, channel string, order_status string")
    orders = orders.withColumn("order_timestamp", F.col("t").cast("timestamp")).withColumn("order_date", F.to_date("order_timestamp")).drop("t")
    items = spark.createDataFrame([(i, o, "P", 4, D("50.00"), D("20.00"), D("180.00")) for i, o, _ in times], "order_item_id string, order_id string, product_id string, quantity int, unit_price decimal(10,2), discount_amount decimal(10,2), net_amount decimal(10,2)")
    products = spark.createDataFrame([("P", 7, D("25.00"))] if known else [], "product_id string, product_key int, cost_price decimal(10,2)")
    stores = spark.createDataFrame([("S", 3)] if known else [], "store_id string, store_key int")
    dates = dims.dim_date(spark, "2023-01-01", "2024-12-31")
    return items, dims.fact_sales(items, orders, dim if known else dim.where("false"), products, stores, dates), dates


def test_sales_resolve_the_version_of_their_time(spark):
    _, fact, _ = star(spark)
    assert {r.order_item_id: r.customer_key for r in fact.collect()} == {"I1": 1, "I2": 2, "I3": 2, "I4": 1}
    r = fact.where("order_item_id = 'I1'").first()
    assert (r.gross_amount, r.net_amount, r.cost_amount, r.profit_amount, r.order_date_key) == (D("200.00"), D("180.00"), D("100.00"), D("80.00"), 20240315)


def test_late_dimensions_give_key_zero(spark):
    _, fact, _ = star(spark, known=False)
    assert {(r.customer_key, r.product_key, r.store_key) for r in fact.collect()} == {(0, 0, 0)}
    strict = checks.suite(checks.unknown_members(fact, "f", ["customer_key"]), fail=False)
    lenient = checks.suite(checks.unknown_members(fact, "f", ["customer_key"], allow=True))
    assert not strict[0].passed and strict[0].severity == "CRITICAL" and lenient[0].passed and lenient[0].severity == "WARNING"
    with pytest.raises(checks.QualityGateError):
        checks.suite(checks.unknown_members(fact, "f", ["customer_key"]))


def test_returns_inherit_and_reconciliation_gates(spark):
    items, fact, dates = star(spark)
    back = spark.createDataFrame([("R1", "I2", "2024-09-01 00:00:00", "DEFECTIVE", "APPROVED", D("180.00")), ("R2", "none", "2024-09-01 00:00:00", "X", "APPROVED", D("1.00"))], "return_id string, order_item_id string, t string, return_reason string, return_status string, refund_amount decimal(10,2)")
    rows = {r.return_id: (r.customer_key, r.order_id, r.return_date_key) for r in dims.fact_returns(back.withColumn("return_timestamp", F.col("t").cast("timestamp")), fact, dates).collect()}
    assert rows == {"R1": (2, "O2", 20240901), "R2": (0, "UNKNOWN", 20240901)}
    assert checks.assert_reconciled(fact, items)["reconciled"]
    with pytest.raises(checks.ReconciliationGateError):
        checks.assert_reconciled(fact.where("order_item_id <> 'I1'"), items)


def test_type1_keeps_keys(spark):
    t = lambda *r: spark.createDataFrame(list(r), "store_id string, name string")
    old = t(("a", "x"), ("b", "y")).join(surrogate_keys(None, t(("a", "x"), ("b", "y")), "store_id", "store_key"), "store_id")
    new = dims.type1(old, t(("b", "z"), ("c", "w")), "store_id", "store_key")
    assert sorted(map(tuple, new.collect())) == [("a", "x", 1), ("b", "z", 2), ("c", "w", 3)]
    assert dims.unknown_member(old, "store_key").where("store_key = 0").first().name == "Unknown"


