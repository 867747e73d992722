"""Change feeds, rows exchanged by key, and KPI tables that follow their sources."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.operators.kpi import KPI
from millrace.plans import layers
from millrace.sources.versioned import ConcurrentCommitError, SchemaMismatchError, VersionedTable

SCHEMAS = {
    "customers": "customer_id string, first_name string, last_name string, email string, loyalty_tier string, phone string",
    "products": "product_id string, category string, subcategory string, cost_price decimal(10,2)",
    "stores": "store_id string, store_name string, store_type string, region string, state string, country string",
    "orders": "order_id string, customer_id string, store_id string, order_date date",
    "order_items": "order_item_id string, order_id string, product_id string, quantity int, unit_price decimal(10,2), discount_amount decimal(10,2), net_amount decimal(10,2)",
    "returns": "return_id string, order_item_id string, return_reason string, refund_amount decimal(10,2)",
}


def put(spark, root, name, rows):
    """Rows of text, typed by the schema."""
    fields = [f.strip().split(" ", 1) for f in SCHEMAS[name].replace("(10,2)", "(10;2)").split(",")]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n, _ in fields)) if rows else spark.createDataFrame([], ", ".join(f"{n} string" for n, _ in fields))
    return VersionedTable(spark, f"{root}/silver/{name}"), df.select(*(F.col(n).cast(t.replace(";", ",")).alias(n) for n, t in fields))


def first(spark, root):
    data = {
        "customers": [(f"C{k}", "a", "b", "e", "GOLD", "1") for k in range(4)],
        "products": [("P0", "K", "x", "1.00"), ("P1", "K", "y", "2.00"), ("P2", None, "z", "3.00")],
        "stores": [(f"S{k}", "n", "Mall", "R", "T", "US") for k in range(3)],
        "orders": [("O0", "C0", "S0", "2024-01-31"), ("O1", "C1", "S1", "2024-02-01"), ("O2", "C1", None, None), ("O3", "C2", "S0", "2024-03-05")],
        "order_items": [(f"I{k}", f"O{k % 4}", f"P{k % 3}", str(k + 1), "10.00", "1.00", str(9 + k)) for k in range(9)],
        "returns": [("R0", "I0", "BAD", "5.00"), ("R1", "I1", None, "6.00"), ("R2", "I3", "BAD", "7.00")],
    }
    for name, rows in data.items():
        t, df = put(spark, root, name, rows)
        t.overwrite(df)


def shown(spark, root):
    return {n: Counter(map(tuple, VersionedTable(spark, f"{root}/gold/{n}").read().collect())) for n in KPI}


def whole(spark, root):
    t = {n: VersionedTable(spark, f"{root}/silver/{n}").read() for n in SCHEMAS}
    return {n: Counter(map(tuple, build(t).collect())) for n, build in KPI.items()}


def test_change_feed(spark, tmp_path):
    t = VersionedTable(spark, tmp_path / "t")
    rows = [(1, "a", None), (2, "b", 1), (2, "b", 1), (3, None, 2)]
    t.overwrite(spark.createDataFrame(rows, "k int, name string, x int"))
    t.update(F.col("k") == 1, {"name": F.lit("A")})
    t.append(spark.createDataFrame([(9, "n", 9, "e")] * 2, "k int, name string, x int, more string"), merge_schema=True)
    t.update(F.col("k") == 3, {"x": F.lit(3)})

    def feed(*a, **b):
        return sorted(map(tuple, t.changes(*a, **b).collect()), key=str)

    assert feed(0, 1) == [(1, "A", None, "insert", 1), (1, "a", None, "delete", 1)]  # equal rows beside them were copied only
    assert feed(1, 1) == [] and feed(1, 2) == [(9, "n", 9, "e", "insert", 2)]
    assert feed(2, columns=["k", "name"]) == [] and feed(2, columns=["x"]) == [(2, "delete", 1), (3, "insert", 1)]
    assert feed(0, columns=["more", "name"]) == sorted([(None, "A", "insert", 1), (None, "a", "delete", 1), ("e", "n", "insert", 2)], key=str)
    with pytest.raises(ValueError, match="before"):
        t.changes(2, 1)
    t.overwrite(spark.createDataFrame([("x",)], "k string"))
    with pytest.raises(SchemaMismatchError):
        t.changes(2)


def test_change_feed_reads_new_files_and_asked_columns_only(spark, tmp_path):
    t = VersionedTable(spark, tmp_path / "t")
    t.overwrite(spark.range(0, 400, 1, 8).select("id", F.lit("x").alias("name"), F.lit("y").alias("other")))
    t.update(F.col("id") == 3, {"name": F.lit("z")})
    df = t.changes(0, columns=["id", "name"])
    assert len(set(df.inputFiles())) == 2  # one of eight before, and what replaced it
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "name:string" in plan and "other" not in plan and plan.count("Exchange") == 1
    assert df.count() == 2


def test_exchange_touches_files_of_its_keys(spark, tmp_path):
    t = VersionedTable(spark, tmp_path / "t")
    t.overwrite(spark.range(0, 2000, 1, 40).select(F.when(F.col("id") != 7, F.col("id")).alias("k"), F.lit(0).alias("v")))
    keys = spark.createDataFrame([(100,), (101,), (100,), (5000,)], "k long")
    assert t.exchange(keys, lambda wanted: wanted.where("k <> 101").withColumn("v", F.lit(1)), "SWAP", 0, {"from": 3}) == 3
    e = t.entry(1)
    assert len(e["remove"]) == 1 and e["opened"] < 5 and e["notes"] == {"from": 3} and e["rows_added"] == 0
    assert {r.k for r in t.read().where("v = 1").collect()} == {100, 5000} and t.read().count() == 2000
    # NULL is a key like any other, and no row may come for a key
    assert t.exchange(spark.createDataFrame([(None,)], "k long"), lambda wanted: wanted.where("false").withColumn("v", F.lit(1)), "SWAP", 1) == 1
    assert t.read().where("k is null").count() == 0 and t.read().count() == 1999
    assert t.exchange(keys.where("false"), lambda wanted: wanted, "SWAP", 2) == 0 and t.read().count() == 1999
    with pytest.raises(ConcurrentCommitError):
        t.exchange(keys, lambda wanted: wanted.withColumn("v", F.lit(1)), "SWAP", 1)


def test_refresh_follows_every_kind_of_change(spark, tmp_path):
    root = str(tmp_path)
    first(spark, root)
    assert set(layers.build_gold(spark, root)) == set(KPI) and shown(spark, root) == whole(spark, root)
    assert set(layers.refresh_gold(spark, root).values()) == {0}
    deliveries = [
        # an order moves to another date, store and customer; one gets a date; one is new
        ("orders", [("O0", "C3", "S1", "2024-03-05"), ("O2", "C1", "S2", "2024-02-01"), ("O4", "C9", "S9", "2024-04-01")]),
        # a line moves to another order and product; one is new, in an order without lines
        ("order_items", [("I1", "O3", "P2", "2", "10.00", "1.00", "9.00"), ("I9", "O4", "P0", "1", "1.00", "0.00", "1.00")]),
        # a cost and a category change; a product that nobody bought is new
        ("products", [("P0", "K", "x", "4.00"), ("P2", "L", "z", "3.00"), ("P9", "M", "m", "1.00")]),
        # a return moves to another line and reason; one is new
        ("returns", [("R0", "I2", None, "5.00"), ("R9", "I4", "NEW", "1.00")]),
        ("stores", [("S0", "renamed", "Mall", "R", "T", "US"), ("S9", "n", "Mall", "R", "T", "US")]),
        ("customers", [("C1", "a", "b", "e", "VIP", "1"), ("C9", "a", "b", "e", "GOLD", "1")]),
    ]
    for k, (name, rows) in enumerate(deliveries):
        t, df = put(spark, root, name, rows)
        t.merge(df, SCHEMAS[name].split(" ")[0])
        if k in (0, 2, 5):
            assert None not in layers.refresh_gold(spark, root).values()
            assert shown(spark, root) == whole(spark, root), name
    # several tables at once, rows that go, and a column that no KPI looks at
    orders = VersionedTable(spark, f"{root}/silver/orders")
    orders.overwrite(orders.read().where("order_id <> 'O3'"))
    items = VersionedTable(spark, f"{root}/silver/order_items")
    items.overwrite(items.read().where("order_item_id not in ('I2', 'I5')"))
    layers.refresh_gold(spark, root)
    assert shown(spark, root) == whole(spark, root)
    VersionedTable(spark, f"{root}/silver/customers").update(F.lit(True), {"phone": F.lit("2")})
    assert set(layers.refresh_gold(spark, root).values()) == {0}


def test_refresh_builds_whole_what_it_cannot_follow(spark, tmp_path):
    root = str(tmp_path)
    first(spark, root)
    assert set(layers.refresh_gold(spark, root).values()) == {None}  # not there yet
    gold = VersionedTable(spark, f"{root}/gold/gold_return_refund_performance")
    gold.overwrite(gold.read().where("false"))  # by somebody who says nothing of versions
    assert layers.refresh_gold(spark, root)[gold.path.rsplit("/", 1)[1]] is None
    assert shown(spark, root) == whole(spark, root)


def test_a_merge_of_few_rows_keeps_what_it_changed(spark, tmp_path):
    t = VersionedTable(spark, tmp_path / "t")
    t.overwrite(spark.range(0, 400, 1, 4).select(F.when(F.col("id") != 7, F.col("id")).alias("k"), (F.col("id") % 3).alias("v"), F.lit("x").alias("kept")))
    source = spark.createDataFrame([(3, 5, "y"), (4, 5, "y"), (150, 0, "y"), (900, 1, "new"), (None, 2, "none")], "k long, v long, kept string")
    # 3 and 150 have v = 0, 4 has 1 and stays; 900 and the row without a key are new
    t.merge(source, "k", lambda a, b: F.col(f"{a}.v") == 0, ("kept",))
    assert t.entry(1)["opened"] == 4 and len(t.entry(1)["remove"]) == 2 and t.entry(1)["rows_added"] == 2 == t.rows() - 400 and t.read().count() == 402
    assert sorted(map(tuple, t.read().where("k in (3, 4, 150, 900) or v = 2 and kept = 'none'").collect()), key=str) == [(150, 0, "x"), (3, 5, "x"), (4, 1, "x"), (900, 1, "new"), (None, 2, "none")]
    assert t.read().where("k is null").count() == 2
    want = sorted([(3, 0, "x", "delete", 1), (3, 5, "x", "insert", 1), (900, 1, "new", "insert", 1), (None, 2, "none", "insert", 1)], key=str)
    feed = t.changes(0)
    assert sorted(map(tuple, feed.collect()), key=str) == want and all("/_changes/" in f for f in feed.inputFiles())
    # one commit that only adds and one that keeps its changes, summed up; then one that keeps nothing
    t.append(spark.createDataFrame([(901, 1, "a")], "k long, v long, kept string"))
    t.merge(spark.createDataFrame([(3, 0, "x"), (900, 2, "new")], "k long, v long, kept string"), "k")
    want = sorted([(900, 2, "new", "insert", 1), (901, 1, "a", "insert", 1), (None, 2, "none", "insert", 1)], key=str)
    feed = t.changes(0)
    assert sorted(map(tuple, feed.collect()), key=str) == want and sum("/_changes/" in f for f in feed.inputFiles()) > 1
    t.update(F.col("k") == 901, {"v": F.lit(0)})
    assert sorted(map(tuple, t.changes(0, columns=["k"]).collect()), key=str) == sorted([(900, "insert", 1), (901, "insert", 1), (None, "insert", 1)], key=str)


def test_a_merge_of_few_rows_moves_only_them(spark, tmp_path, monkeypatch):
    """Also with more keys than are broadcast, and where rows of the table share a key."""
    for limit in (10, 1):
        monkeypatch.setattr("millrace.sources.versioned.BROADCAST_KEYS", limit)
        t = VersionedTable(spark, tmp_path / f"t{limit}")
        t.overwrite(spark.range(0, 200, 1, 4).selectExpr("id % 100 as a", "id % 2 as b", "'x' as name"))
        t.merge(spark.createDataFrame([(5, 1, "new"), (5, 0, "added")], "a long, b long, name string"), ["a", "b"])
        assert Counter(map(tuple, t.read().where("a = 5").collect())) == Counter({(5, 1, "new"): 2, (5, 0, "added"): 1}) and t.read().count() == 201
        assert sorted(map(tuple, t.changes(0).collect())) == [(5, 0, "added", "insert", 1), (5, 1, "new", "insert", 2), (5, 1, "x", "delete", 2)]
