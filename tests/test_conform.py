from __future__ import annotations

from millrace.functions.expr import as_date, as_timestamp, blank, flag, money, row_hash
from millrace.operators.conform import REDELIVERED, conform, latest, orphans, redelivered, referenced
from millrace.operators.rules import BATCH, SILVER
from millrace.plans.batch import Metric
from millrace.sources.schema import DATASETS


def raw(spark, name, rows, lineage=None):
    d = DATASETS[name]
    full = [tuple(r.get(c) for c in d.columns) for r in rows]
    df = spark.createDataFrame(full, d.schema)
    if lineage:
        from pyspark.sql import functions as F

        df = df.withColumn("_ingested_timestamp", F.lit(lineage).cast("timestamp"))
    return df


CUSTOMER = {"first_name": "ann", "last_name": "lee", "signup_date": "2023-01-02"}


def test_customers_each_defect_has_its_reason(spark):
    rows = [
        CUSTOMER | {"customer_id": " C1 ", "first_name": "  jOHN ", "last_name": "doe", "email": " John@X.com ", "state": " ca ", "loyalty_tier": "gold"},
        CUSTOMER | {"customer_id": "C1", "email": "z@x.com", "signup_date": "2020-01-01"},
        CUSTOMER | {"customer_id": "C2", "email": "x_at_example_no_domain"},
        CUSTOMER | {"customer_id": "", "email": "a@x.com"},
        CUSTOMER | {"customer_id": "C3", "email": "b@x.com", "signup_date": "2023-99-99"},
    ]
    both = conform(raw(spark, "customers", rows), BATCH["customers"])
    valid = both.valid.collect()
    assert [(r.customer_id, r.full_name, r.email, r.state, r.loyalty_tier, r.country) for r in valid] == [("C1", "John Doe", "john@x.com", "CA", "GOLD", "US")]
    assert {r.record_id: r.rejection_reason for r in both.quarantine.collect()} == {"C1": "DUPLICATE_CUSTOMER_ID", "C2": "INVALID_EMAIL_FORMAT", "": "NULL_MANDATORY_FIELD", "C3": "MALFORMED_SIGNUP_DATE"}
    m = Metric.of("customers", both.by_reason())
    assert (m.source_row_count, m.valid_row_count, m.quarantine_row_count, m.duplicate_count, m.null_mandatory_count) == (5, 1, 4, 1, 1)


def test_quarantine_keeps_what_was_delivered(spark):
    both = conform(raw(spark, "customers", [CUSTOMER | {"customer_id": "C3", "email": "b@x.com", "signup_date": "2023-99-99"}]), BATCH["customers"])
    assert '"signup_date":"2023-99-99"' in both.quarantine.first().raw_record


def test_rank_comes_before_validity(spark):
    rows = [CUSTOMER | {"customer_id": "C1", "email": "bad", "signup_date": "2024-01-01"}, CUSTOMER | {"customer_id": "C1", "email": "good@x.com"}]
    reasons = conform(raw(spark, "customers", rows), BATCH["customers"]).by_reason()
    assert reasons == {"INVALID_EMAIL_FORMAT": 1, "DUPLICATE_CUSTOMER_ID": 1}


def test_batch_orders_null_status_and_blank_time_pass_silver_rejects(spark):
    order = {"order_id": "O1", "customer_id": "C", "store_id": "S", "employee_id": "E", "order_timestamp": "", "order_status": None, "total_amount": "1.00"}
    parents = {"customers": spark.createDataFrame([("C",)], "customer_id string"), "stores": spark.createDataFrame([("S",)], "store_id string"), "employees": spark.createDataFrame([("E",)], "employee_id string")}
    df = raw(spark, "orders", [order], "2024-01-01")
    assert conform(df, BATCH["orders"], parents).by_reason() == {None: 1}
    assert conform(df, SILVER["orders"], parents).by_reason() == {"MALFORMED_ORDER_TIMESTAMP": 1}


def test_orphans_and_null_references(spark):
    child = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "i int, k string")
    parent = spark.createDataFrame([("a",), ("a",)], "k string")
    assert sorted(r.i for r in orphans(child, parent, "k").collect()) == [2, 3]
    assert [r.i for r in referenced(child, parent, "k").collect()] == [1]


def test_payment_must_match_its_order(spark):
    orders = spark.createDataFrame([("O1", "108.00"), ("O2", "108.00")], "order_id string, t string").selectExpr("order_id", "cast(t as decimal(12,2)) total_amount")
    pay = {"payment_timestamp": "2024-01-01 00:00:00", "payment_status": "SUCCESS"}
    both = conform(raw(spark, "payments", [pay | {"payment_id": "P1", "order_id": "O1", "payment_amount": "108.00"}, pay | {"payment_id": "P2", "order_id": "O2", "payment_amount": "150.00"}]), BATCH["payments"], {"orders": orders})
    assert both.by_reason() == {None: 1, "PAYMENT_AMOUNT_UNRECONCILED": 1}


def test_silver_amounts_and_null_discount(spark):
    item = {"order_id": "O", "product_id": "P", "unit_price": "50.00"}
    parents = {"orders": spark.createDataFrame([("O",)], "order_id string"), "products": spark.createDataFrame([("P",)], "product_id string")}
    rows = [item | {"order_item_id": "1", "quantity": "2", "discount_percent": "0.10"}, item | {"order_item_id": "2", "quantity": "1", "discount_percent": None}, item | {"order_item_id": "3", "quantity": "x", "discount_percent": "0"}]
    both = conform(raw(spark, "order_items", rows, "2024-01-01"), SILVER["order_items"], parents)
    assert {r.order_item_id: (r.discount_amount and str(r.discount_amount), r.net_amount and str(r.net_amount)) for r in both.valid.collect()} == {"1": ("10.00", "90.00"), "2": (None, None)}
    assert both.by_reason()["INVALID_QUANTITY"] == 1


def test_dedup_does_not_depend_on_input_order(spark):
    a = CUSTOMER | {"customer_id": "C1", "email": "a@x.com", "city": "x"}
    b = CUSTOMER | {"customer_id": "C1", "email": "a@x.com", "city": "y"}
    winners = {conform(raw(spark, "customers", rows, "2024-01-01"), SILVER["customers"]).valid.first().city for rows in ([a, b], [b, a])}
    assert len(winners) == 1


def test_parsers_give_null_under_ansi(spark):
    df = spark.createDataFrame([("2023-99-99",), ("INVALID_DATE",), ("2024-02-31 25:61:99",), (" 2024-02-29 ",), ("",), (None,)], "x string")
    assert [str(r[0]) for r in df.select(as_date("x")).collect()] == ["None", "None", "None", "2024-02-29", "None", "None"]
    assert all(r[0] is None for r in df.select(as_timestamp("x")).collect())
    df = spark.createDataFrame([("12.345",), ("1e20",), ("N/A",), (" 7 ",)], "x string")
    assert [r[0] and str(r[0]) for r in df.select(money("x")).collect()] == ["12.35", None, None, "7.00"]
    df = spark.createDataFrame([(" TRUE ",), ("no",), (None,), (" ",)], "x string")
    assert [tuple(r) for r in df.select(flag("x"), blank("x")).collect()] == [(True, False), (False, False), (False, True), (False, True)]
    assert df.select(row_hash(["x"])).distinct().count() == 4


def test_empty_tables(spark):
    both = conform(raw(spark, "customers", []), BATCH["customers"])
    assert both.by_reason() == {} and both.valid.count() == 0


def executions(spark):
    return spark._jsparkSession.sharedState().statusStore().executionsCount()


def test_reasons_are_counted_while_valid_rows_are_written(spark, tmp_path):
    rows = [CUSTOMER | {"customer_id": f"C{i % 90}", "email": "a@x.com" if i % 7 else "bad"} for i in range(100)] + [CUSTOMER] * 5
    both = conform(raw(spark, "customers", rows), BATCH["customers"])
    valid, counted = both.observed()
    before = executions(spark)
    valid.write.parquet(str(tmp_path / "valid"))
    found = counted()
    assert executions(spark) == before + 1
    assert found == both.by_reason() and sum(found.values()) == 105
    assert spark.read.parquet(str(tmp_path / "valid")).count() == found[None]
    valid, counted = conform(raw(spark, "customers", []), BATCH["customers"]).observed()
    valid.write.parquet(str(tmp_path / "none"))
    assert counted() == {}


def test_redelivered_rows(spark):
    """(text, moment, file): equal content in a later delivery; NULL is not empty text; equal rows of one delivery are alike."""
    rows = [("a", 1, "f"), ("a", 1, "f"), ("a", 2, "g"), ("a", 2, "h"), (None, 1, "f"), ("", 2, "g"), (None, 3, None), ("b", None, "f"), ("b", 1, "f"), ("c", 1, "f")]
    df = spark.createDataFrame([(t, "x||", m, i) for t, m, i in rows], "t string, u string, m int, _ingestion_id string").selectExpr("t", "u", "timestamp_seconds(m) _ingested_timestamp", "_ingestion_id")
    got = sorted((str(r.t), r._ingested_timestamp is not None and r._ingested_timestamp.second, str(r._ingestion_id)) for r in redelivered(df).where("_redelivered").collect())
    assert got == sorted([("a", 1, "f"), ("a", 1, "f"), ("a", 2, "g"), ("None", 1, "f"), ("b", False, "f")])
    glued = spark.createDataFrame([("x||y", "z", 1), ("x", "y||z", 2)], "t string, u string, m int").selectExpr("t", "u", "timestamp_seconds(m) _ingested_timestamp")
    assert redelivered(glued).where("_redelivered").count() == 0
    assert redelivered(glued.drop("_ingested_timestamp")).where("_redelivered").count() == 0
    assert redelivered(df.limit(0)).count() == 0


def test_a_second_snapshot_changes_no_reason_but_one(spark):
    first = [CUSTOMER | {"customer_id": f"C{i % 9}", "email": f"{i}@x.com" if i % 4 else "bad"} for i in range(12)] + [CUSTOMER | {"email": "a@x.com"}] * 2
    one = raw(spark, "customers", first, "2024-01-01")
    two = one.unionByName(raw(spark, "customers", first, "2024-01-02"))
    want = conform(one, SILVER["customers"]).by_reason()
    assert conform(two, SILVER["customers"], supersede=True).by_reason() == want | {REDELIVERED: 14}
    assert conform(two, SILVER["customers"]).by_reason() != want | {REDELIVERED: 14}
    kept = conform(two, SILVER["customers"], supersede=True)
    assert {str(r._ingested_timestamp)[:10] for r in kept.valid.collect()} == {"2024-01-02"}
    assert "_redelivered" not in kept.rejected.columns and kept.rejected.where("_raw.email is null").count() == 0


def test_latest_ranks_only_rows_of_repeated_keys(spark, tmp_path):
    from pyspark.sql import functions as F

    path = str(tmp_path / "t")
    spark.range(3000).selectExpr("case when id % 3 = 0 then 7 when id < 40 then null when id < 60 then id div 2 else id end as k", "id % 5 as v", "cast(id % 11 as string) as w").union(spark.range(2).selectExpr("9999", "4", "'same'")).write.parquet(path)
    df = spark.read.parquet(path)
    want = {}
    for r in df.collect():
        want.setdefault(r.k, []).append(r)
    order = [F.col("v").desc(), F.col("w").asc()]
    for bound in (1_000_000, 0):
        got = latest(df, ["k"], order, bound).collect()
        assert len(got) == len(want)
        for r in got:
            assert (r.v, r.w) == min(((x.v, x.w) for x in want[r.k]), key=lambda p: (-p[0], p[1]))
    plan = latest(df, ["k"], order)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and plan.count("hashpartitioning(k") == 1
    once = df.where("k > 100 and k < 9999")
    assert "Window" not in latest(once, ["k"], order)._jdf.queryExecution().executedPlan().toString()
    assert latest(df.limit(0), ["k"], order).count() == 0
