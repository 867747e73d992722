"""Every operator as a query over the driver's tables. ``oracles`` has the same in plain SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import replace
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from millrace.bindings.retail import frame, frames
from millrace.functions.expr import money
from millrace.operators import checks, dimensions as dims
from millrace.operators.blocks import as_of
from millrace.operators.conform import Conformed, conform, latest, orphans, referenced
from millrace.operators.curate import curated_sales, order_metrics, order_totals, product_ranks, product_totals, sales_lines
from millrace.operators.incremental import KEPT
from millrace.operators.keys import surrogate_keys
from millrace.operators.kpi import KPI
from millrace.operators.rules import BATCH, ORDER, SILVER
from millrace.plans.layers import audit_table, build_silver, ingest_bronze, load, merge_customers, refresh_kpi
from millrace.plans.serving import KPI_QUERIES, KPI_VIEWS, OPERATIONS, REPORTS, STAR_QUERIES, STAR_VIEWS
from millrace.session import shared_dir, sql_over
from millrace.sources.files import scan, scan_as_text, write
from millrace.sources.landing import discover, pending
from millrace.sources.named import enable
from millrace.sources.schema import DATASETS
from millrace.sources.versioned import VersionedTable, merged

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
HISTORY_START, SECOND_BATCH = "1990-01-01 00:00:00", "1995-06-01 00:00:00"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_long(df: DataFrame) -> DataFrame:
    """Counters and sums of integers as bigint, wide decimals as decimal(18,2), so that both engines name one type."""
    cast = {f.name: "bigint" if f.dataType.typeName() in ("integer", "long", "short") else "decimal(18,2)" for f in df.schema if f.dataType.typeName() in ("integer", "long", "short", "decimal")}
    return df.select(*(F.col(c).cast(cast[c]).alias(c) if c in cast else F.col(c) for c in df.columns))


# reports on curated sales


def _curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = frames(spark, sf_dir, "c_orders", "c_order_items", "c_products", "c_customers", "c_stores")
    return curated_sales(t["orders"], t["order_items"], t["products"], t["customers"], t["stores"])


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curated lines without the windows, which no report asks for."""
    t = frames(spark, sf_dir, "c_orders", "c_order_items", "c_products", "c_customers", "c_stores")
    return sales_lines(t["orders"], t["order_items"], t["products"], t["customers"], t["stores"])


def _report(name: str) -> Query:
    return lambda spark, sf_dir: as_long(sql_over(spark, {"v_curated_sales": _lines(spark, sf_dir), "v_returns": frame(spark, sf_dir, "c_returns")}, REPORTS[name]))


QUERIES["revenue_by_region_channel"] = _report("revenue_by_region")


@query
def daily_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = frames(spark, sf_dir, "c_orders", "c_order_items", "c_products", "c_customers", "c_stores")
    totals = order_totals(t["orders"], t["order_items"], t["products"], t["customers"], t["stores"])
    return as_long(sql_over(spark, {"v_order_totals": totals}, REPORTS["daily_revenue"]))


QUERIES["top_products_per_category"] = _report("top_products")
QUERIES["category_return_rate"] = _report("category_returns")


@query
def curated_sales_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["order_item_id", "order_id", "customer_id", "gross_sales", "discount_amount", "net_sales", "cost_amount", "gross_profit", "order_year", "order_month", "order_day", "customer_order_sequence", "days_since_prior_order", "customer_running_spend", "category_product_rank"]
    return as_long(_curated(spark, sf_dir).select(*cols))


def _metric(column: str) -> Query:
    return lambda spark, sf_dir: as_long(order_metrics(_lines(spark, sf_dir), frame(spark, sf_dir, "c_orders")).select("customer_id", "order_id", column))


QUERIES["customer_order_sequence"] = _metric("customer_order_sequence")
QUERIES["days_since_prior"] = _metric("days_since_prior_order")
QUERIES["running_spend"] = _metric("customer_running_spend")


@query
def category_product_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = frames(spark, sf_dir, "c_orders", "c_order_items", "c_products", "c_customers", "c_stores")
    return as_long(product_ranks(product_totals(t["orders"], t["order_items"], t["products"], t["customers"], t["stores"]), t["products"]))


# conformance


def conformed(spark: SparkSession, sf_dir: str, specs: dict, name: str, done: dict[str, Conformed] | None = None) -> Conformed:
    """A dataset with its parents, and theirs, conformed first; those that are ``done`` are taken as they are."""
    spec = specs[name]
    parents = {p.parent: (done[p.parent] if done and p.parent in done else conformed(spark, sf_dir, specs, p.parent, done)).valid for p in spec.parents}
    return conform(frame(spark, sf_dir, f"r_{name}"), spec, parents)


def all_conformed(spark: SparkSession, sf_dir: str, specs: dict) -> dict[str, Conformed]:
    """Every dataset conformed once, parents first, each written to the shared folder: its reasons, and the columns that datasets which refer to it read.

    The tie-breaking hash is of all columns, but taken before rows are ranked, so other columns that no rule looks at are not shuffled.
    """
    read = {name: dict.fromkeys(c for s in specs.values() for p in s.parents if p.parent == name for c in (p.parent_key, *p.carry)) for name in ORDER}
    done: dict[str, Conformed] = {}
    for name in ORDER:
        tagged = conformed(spark, sf_dir, specs, name, done).tagged
        done[name] = Conformed(replace(specs[name], output=()), _written(spark, name, tagged.select(*read[name], "_reason")))
    return done


def _reasons(specs: dict, name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tagged = conformed(spark, sf_dir, specs, name).tagged
        return tagged.groupBy(F.coalesce("_reason", F.lit("VALID")).alias("reason")).agg(F.count("*").alias("n"))

    return run


for _name in ORDER:
    QUERIES[f"conform_batch_{_name}"] = _reasons(BATCH, _name)
    QUERIES[f"conform_silver_{_name}"] = _reasons(SILVER, _name)


@query
def conform_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean customers themselves."""
    return conformed(spark, sf_dir, BATCH, "customers").valid


@query
def conform_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who was rejected and why, with what was delivered."""
    return conformed(spark, sf_dir, BATCH, "customers").rejected.select("customer_id", "quarantine_reason", F.col("_raw.signup_date").alias("delivered_signup_date"), F.col("_raw.email").alias("delivered_email"))


@query
def json_quarantine_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The uniform quarantine form; the JSON is read back, as engines print it differently."""
    q = conformed(spark, sf_dir, BATCH, "customers").quarantine
    return q.select("record_id", "source_dataset", "rejection_reason", F.get_json_object("raw_record", "$.signup_date").alias("raw_signup_date"))


@query
def redelivered_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by reason when customers, products and stores come twice, whole, some customers having moved in between."""

    def one(name: str) -> DataFrame:
        first = frame(spark, sf_dir, f"r_{name}")
        again = first.withColumn("_ingested_timestamp", F.expr("_ingested_timestamp + interval 7 days"))
        if name == "customers":
            again = again.withColumn("city", F.when(F.col("customer_id").endswith("4"), "moved").otherwise(F.col("city")))
        tagged = conform(first.unionByName(again), SILVER[name], supersede=True).tagged
        return tagged.groupBy(F.coalesce("_reason", F.lit("VALID")).alias("reason")).agg(F.count("*").alias("n")).withColumn("dataset_name", F.lit(name))

    return reduce(DataFrame.unionByName, map(one, ("customers", "products", "stores")))


@query
def quality_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of each dataset, in one pass over each."""
    done = all_conformed(spark, sf_dir, BATCH)

    def one(name: str) -> DataFrame:
        r, n = F.col("_reason"), F.count("*")
        return (
            done[name]
            .tagged.agg(
                n.alias("source_row_count"),
                F.count_if(r.isNull()).alias("valid_row_count"),
                F.count_if(r.isNotNull()).alias("quarantine_row_count"),
                F.count_if(r.startswith("DUPLICATE")).alias("duplicate_count"),
                F.count_if(r.startswith("NULL_MANDATORY")).alias("null_mandatory_count"),
                F.count_if(r.startswith("ORPHAN")).alias("referential_orphan_count"),
            )
            .withColumn("dataset_name", F.lit(name))
        )

    return reduce(DataFrame.unionByName, (one(n) for n in ORDER))


@query
def dedup_latest_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = source(spark, sf_dir, "lineitem")
    rest = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    out = latest(li, ["l_orderkey", "l_linenumber"], [F.col(rest[0]).desc_nulls_last(), *(F.col(c).asc_nulls_last() for c in rest[1:])])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def _known_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source(spark, sf_dir, "customer").where("c_custkey % 100 <> 0")


@query
def orphan_probe_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a tenth of the customers, who are taken for unknown: the given tables have no other orphan."""
    known = source(spark, sf_dir, "customer").where("c_custkey % 10 <> 3")
    return orphans(source(spark, sf_dir, "orders"), known, "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@query
def fk_valid_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return referenced(source(spark, sf_dir, "orders"), _known_customers(spark, sf_dir), "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@query
def payment_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by how their total compares with the sum of their lines, within a tenth."""
    lines = source(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice").cast("decimal(12,2)")).alias("paid"))
    total = F.col("o_totalprice").cast("decimal(12,2)")
    state = F.when(F.col("paid").isNull(), "NO_PAYMENT").when(F.abs(F.col("paid") - total) > total * F.lit(0.1).cast("decimal(3,1)"), "UNRECONCILED").otherwise("RECONCILED")
    return source(spark, sf_dir, "orders").join(lines, "o_orderkey", "left").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


# KPI tables and their queries


def _kpi_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return frames(spark, sf_dir, "c_customers", "c_products", "c_stores", "c_orders", "c_order_items", "c_returns")


def _kpi(name: str) -> Query:
    return lambda spark, sf_dir: as_long(KPI[name](_kpi_tables(spark, sf_dir)))


GOLD = {
    "gold_daily": "gold_daily_sales_performance",
    "gold_monthly": "gold_monthly_revenue",
    "gold_store_region": "gold_revenue_by_store_region",
    "gold_category": "gold_category_revenue_performance",
    "gold_customer": "gold_customer_spending_summary",
    "gold_returns": "gold_return_refund_performance",
}
for _name, _table in GOLD.items():
    QUERIES[_name] = _kpi(_table)


def _kpi_query(sql: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = _kpi_tables(spark, sf_dir)
        return as_long(sql_over(spark, {n: build(t) for n, build in KPI.items() if n in sql}, sql))

    return run


for _name, _sql in KPI_QUERIES.items():
    QUERIES[_name] = _kpi_query(_sql)
for _name, _sql in KPI_VIEWS.items():
    QUERIES[f"view_{_name}"] = _kpi_query(_sql)


#: Keys of datasets (ids of products and customers are cut to six digits and repeat beyond a million, SKU and address do not), and how rows of a first delivery differ from those of the second where they do.
EARLIER = {
    "customers": ("email", {"loyalty_tier": "'NONE'"}),
    "products": ("product_sku", {"cost_price": "cost_price + 1", "subcategory": "'none'"}),
    "stores": ("store_id", {"region": "'NONE'"}),
    "orders": ("order_id", {"order_date": "date_add(order_date, -40)", "store_id": "'STR-00001'", "customer_id": "'CUST-000001'"}),
    "order_items": ("order_item_id", {"quantity": "quantity + 1", "net_amount": "net_amount + 5"}),
    "returns": ("return_id", {"return_reason": "'OTHER'", "refund_amount": "refund_amount + 1"}),
}


def _two_deliveries(spark: SparkSession, sf_dir: str, names: Iterable[str]) -> Iterator[dict[str, VersionedTable]]:
    """Silver tables after a first delivery, which lacks rows and has others in an earlier state; then after the second."""
    silver, late = {}, {}
    for name in names:
        key, was = EARLIER[name]
        now = frame(spark, sf_dir, f"c_{name}")
        turn = F.regexp_replace(key, "[^0-9]", "").cast("bigint") % 100
        silver[name] = VersionedTable(spark, _place(spark, f"silver_{name}"))
        early = {c: F.when(turn == 1, F.expr(e).cast(now.schema[c].dataType)).otherwise(F.col(c)) for c, e in was.items()}
        silver[name].overwrite(now.where(turn != 0).withColumns(early))
        late[name] = now.where(turn <= 1)
    yield silver
    for name, rows in late.items():
        silver[name].merge(rows, EARLIER[name][0])
    yield silver


def _refreshed(table: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The KPI table of a first delivery, brought up to the second: only keys that it touches are computed anew."""
        gold = VersionedTable(spark, _place(spark, table))
        for silver in _two_deliveries(spark, sf_dir, KEPT[table].uses):
            refresh_kpi(gold, table, silver)
        return as_long(gold.read())

    return run


for _name, _table in GOLD.items():
    QUERIES[f"{_name}_refreshed"] = _refreshed(_table)


@query
def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the second delivery of orders changed, without what was only copied to other files."""
    *_, silver = _two_deliveries(spark, sf_dir, ["orders"])
    return silver["orders"].changes(0, columns=["order_id", "order_date", "store_id"]).select("order_id", "order_date", "store_id", "_change", "_copies")


# dimensions and facts


@query
def dim_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_long(dims.dim_date(spark))


@query
def dim_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_long(dims.dim_store(frame(spark, sf_dir, "c_stores")))


@query
def dim_employee(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_long(dims.dim_employee(frame(spark, sf_dir, "c_employees"), dims.dim_store(frame(spark, sf_dir, "c_stores"))))


@query
def dim_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_long(dims.dim_product(frame(spark, sf_dir, "c_products")))


@query
def unknown_member_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_long(dims.unknown_member(dims.dim_store(frame(spark, sf_dir, "c_stores")), "store_key").select("store_key", "store_id", "region"))


@query
def surrogate_keys_initial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_long(surrogate_keys(None, frame(spark, sf_dir, "c_customers"), "customer_id", "customer_key"))


@query
def surrogate_keys_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = frame(spark, sf_dir, "c_customers").where("cast(substring(customer_id, 6) as int) % 3 <> 0")
    return as_long(surrogate_keys(surrogate_keys(None, first, "customer_id", "customer_key"), frame(spark, sf_dir, "c_customers"), "customer_id", "customer_key"))


def _products_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later delivery: some prices differ, products that the first lacked are there, and some of the first are not."""
    new = F.when(F.expr("cast(substring(product_id, 6) as int) % 5 = 1"), (F.col("unit_price") + 1).cast("decimal(10,2)")).otherwise(F.col("unit_price"))
    return frame(spark, sf_dir, "c_products").where("cast(substring(product_id, 6) as int) % 100 <> 50").withColumn("unit_price", new)


@query
def scd1_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = dims.dim_product(frame(spark, sf_dir, "c_products").where("cast(substring(product_id, 6) as int) % 100 <> 0"))
    return as_long(dims.type1(first, _products_next(spark, sf_dir), "product_id", "product_key").select("product_id", "unit_price", "product_key"))


@query
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders merged with a later state of all; the first delivery lacks some."""
    old = source(spark, sf_dir, "orders").where("o_orderkey % 100 <> 0").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("total"))
    new = source(spark, sf_dir, "orders").select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.col("o_totalprice").cast("decimal(18,2)").alias("total"))
    return merged(old, new, "o_orderkey", lambda t, s: F.col(f"{s}.total") > 100000)


def _dim_customer(spark: SparkSession, sf_dir: str, counted: bool = False) -> tuple[DataFrame, bool]:
    """The history of customers after two deliveries, and whether customers share ids: then it has all rows that joins by id give, or, if ``counted``, ``_copies``."""
    first = frame(spark, sf_dir, "c_customers").where("cast(substring(customer_id, 6) as int) % 100 <> 0")
    existing = _written(spark, "dim_customer_first", dims.scd2_initial(first, HISTORY_START))  # a batch meets a table, which it reads several times
    later = frame(spark, sf_dir, "c_customers_next")
    try:
        return dims.scd2_apply(existing, later, SECOND_BATCH), False
    except dims.DuplicateKeyError:
        rows = dims.scd2_shared(existing, later, SECOND_BATCH)
        return rows if counted else dims.copied(rows), True


_SCD2 = ["customer_key", "customer_id", "address", "loyalty_tier", "attribute_hash", "effective_from", "effective_to", "is_current", "version_number"]


@query
def scd2_initial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_long(dims.scd2_initial(frame(spark, sf_dir, "c_customers"), HISTORY_START).select(*_SCD2))


@query
def scd2_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_long(_dim_customer(spark, sf_dir)[0].select(*_SCD2))


@query
def scd2_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same history, in a versioned table of which only files with an ended version are rewritten."""
    t = VersionedTable(spark, _place(spark, "dim_customer"))
    first = frame(spark, sf_dir, "c_customers").where("cast(substring(customer_id, 6) as int) % 100 <> 0")
    t.overwrite(dims.scd2_initial(first, HISTORY_START).repartitionByRange(MERGED_FILES, "customer_id"))
    ended, versions = dims.scd2_batch(t.read(), frame(spark, sf_dir, "c_customers_next"), SECOND_BATCH)
    t.revise(ended, "customer_id", "is_current", dims.ending(SECOND_BATCH), versions, "SCD2", 0)
    return as_long(t.read().select(*_SCD2))


@query
def scd2_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose current version was closed without a successor get a next one."""
    dim = dims.scd2_initial(frame(spark, sf_dir, "c_customers"), HISTORY_START)
    hurt = F.expr("cast(substring(customer_id, 6) as int) % 17 = 3")
    dim = dim.withColumns({"effective_to": F.when(hurt, F.lit("1992-01-01 00:00:00").cast("timestamp")).otherwise(F.col("effective_to")), "is_current": ~hurt})
    return as_long(dims.scd2_apply(dim, frame(spark, sf_dir, "c_customers"), SECOND_BATCH).select(*_SCD2))


STAR = ("dim_customer", "dim_product", "dim_store", "fact_sales", "fact_returns")
DIMENSIONS = STAR[:3]


def star(spark: SparkSession, sf_dir: str, save: tuple[str, ...] = DIMENSIONS, columns: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """The star schema, lazily but for tables to ``save``: those are written once to the shared folder, for uses that read them often.

    Dimensions are by default: facts and reports both read them, and the size of a written table tells whether a join
    may broadcast it, so that facts are not shuffled to meet a small one. Of fact_sales only ``columns`` are kept, if given: what
    nobody looks at is then neither written nor shuffled on the way. Rows are all there.
    """

    def kept(name: str, df: DataFrame) -> DataFrame:
        return _written(spark, name, df) if name in save else df

    t = frames(spark, sf_dir, "c_products", "c_stores", "c_orders", "c_order_items", "c_returns")
    history, shared = _dim_customer(spark, sf_dir)
    s = {"dim_date": dims.dim_date(spark, "1992-01-01", "1999-12-31"), "dim_customer": kept("dim_customer", history), "dim_product": kept("dim_product", dims.dim_product(t["products"])), "dim_store": kept("dim_store", dims.dim_store(t["stores"]))}
    sales = dims.fact_sales(t["order_items"], t["orders"], s["dim_customer"], s["dim_product"], s["dim_store"], s["dim_date"], shared)
    s["fact_sales"] = kept("fact_sales", sales.select(*columns) if columns else sales)
    s["fact_returns"] = kept("fact_returns", dims.fact_returns(t["returns"], s["fact_sales"] if not columns or "order_id" in columns else sales, s["dim_date"]))
    return s


#: What checks look at in dim_customer.
_HISTORY = ("customer_key", "customer_id", "effective_from", "effective_to", "is_current")


def _spells(spark: SparkSession, history: DataFrame, shared: bool) -> DataFrame:
    return _written(spark, "spells", dims.spells(history)) if shared else history.withColumn(dims.COPIES, F.lit(1).cast("bigint"))


def star_by_product(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """What reports read that ask for products alone: sales by product id, which no product multiplies, and the products."""
    t = frames(spark, sf_dir, "c_products", "c_stores", "c_orders", "c_order_items")
    history, shared = _dim_customer(spark, sf_dir, counted=True)
    versions = _spells(spark, _written(spark, "dim_customer", history.select(*_HISTORY, *((dims.COPIES,) if shared else ()))), shared)
    orders = dims.counted_orders(t["orders"], versions, _written(spark, "dim_store", dims.dim_store(t["stores"])), dims.dim_date(spark, "1992-01-01", "1999-12-31"))
    return {"sales_by_product": dims.sales_by_product(t["order_items"], orders), "v_products": t["products"]}


def star_counted(spark: SparkSession, sf_dir: str, save: tuple[str, ...] = DIMENSIONS, columns: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """The star schema for uses that count rows, as ``star``: facts have a row for each item, and in ``_copies`` how many they are there.

    dim_customer has the columns of ``_HISTORY``, and ``_copies`` too where customers share ids.
    """

    def kept(name: str, df: DataFrame) -> DataFrame:
        return _written(spark, name, df) if name in save else df

    t = frames(spark, sf_dir, "c_products", "c_stores", "c_orders", "c_order_items", "c_returns")
    history, shared = _dim_customer(spark, sf_dir, counted=True)
    s = {"dim_date": dims.dim_date(spark, "1992-01-01", "1999-12-31"), "dim_customer": kept("dim_customer", history.select(*_HISTORY, *((dims.COPIES,) if shared else ()))), "dim_product": kept("dim_product", dims.dim_product(t["products"])), "dim_store": kept("dim_store", dims.dim_store(t["stores"]))}
    orders = dims.counted_orders(t["orders"], _spells(spark, s["dim_customer"], shared), s["dim_store"], s["dim_date"])
    sales = dims.counted_sales(t["order_items"], orders, s["dim_product"])
    s["fact_sales"] = kept("fact_sales", sales.select(*columns, dims.COPIES) if columns else sales)
    s["fact_returns"] = kept("fact_returns", dims.fact_returns(t["returns"], s["fact_sales"] if not columns or "order_id" in columns else sales, s["dim_date"]))
    return s


@query
def fact_sales_pit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_long(star(spark, sf_dir)["fact_sales"])


@query
def fact_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_long(star(spark, sf_dir)["fact_returns"])


def _star_query(sql: str) -> Query:
    return lambda spark, sf_dir: as_long(sql_over(spark, star(spark, sf_dir), sql))


def star_by_order(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """What reports read that ask for no product: sales by order and the other dimensions, which are written as in ``star``."""
    t = frames(spark, sf_dir, "c_products", "c_stores", "c_orders", "c_order_items")
    history, shared = _dim_customer(spark, sf_dir)
    s = {"dim_date": dims.dim_date(spark, "1992-01-01", "1999-12-31"), "dim_customer": _written(spark, "dim_customer", history), "dim_store": _written(spark, "dim_store", dims.dim_store(t["stores"]))}
    return s | {"sales_by_order": dims.sales_by_order(t["order_items"], t["orders"], s["dim_customer"], t["products"], s["dim_store"], s["dim_date"], shared)}


def _order_query(sql: str) -> Query:
    return lambda spark, sf_dir: as_long(sql_over(spark, star_by_order(spark, sf_dir), sql))


def _product_query(sql: str) -> Query:
    return lambda spark, sf_dir: as_long(sql_over(spark, star_by_product(spark, sf_dir), sql))


for _name, _sql in STAR_QUERIES.items():
    QUERIES[_name] = (_order_query if "sales_by_order" in _sql else _product_query if "sales_by_product" in _sql else _star_query)(_sql)
for _name, _sql in STAR_VIEWS.items():
    QUERIES[f"{_name}_view"] = _star_query(_sql)


@query
def pit_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases with the state of their user then: sign-ups and errors open versions, the next one ends them."""
    e = source(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    v = e.where("event_type in ('signup', 'error')").select(F.col("user_id").alias("v_user"), F.col("event_id").alias("version_id"), F.col("ts").alias("effective_from"), F.lead("ts").over(w).alias("effective_to"))
    buys = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    out = as_of(buys, v, "user_id", "ts", "v_user", "effective_from", "effective_to", ["version_id"], few=0)
    return out.select("event_id", F.coalesce("version_id", F.lit(-1)).cast("bigint").alias("version_id"))


# quality


def _check(kind: str, save: tuple[str, ...], columns: tuple[str, ...] = ()) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        chosen = checks.warehouse_checks(star_counted(spark, sf_dir, save, columns), kind=kind)
        return checks.evaluated(chosen).select("check_name", "table_name", "failed_rows", "passed")

    return run


#: What checks look at in fact_sales; with the item and its order fact_returns can be made of it.
_KEYS = ("customer_key", "product_key", "store_key", "order_date_key")
_ITEM_KEYS = ("order_item_id", "order_id", *_KEYS)

for _name, _kind, _save, _columns in (
    ("completeness", "COMPLETENESS", STAR[:-1], (*_ITEM_KEYS, "net_amount")), ("uniqueness", "UNIQUENESS", STAR[:-1], _ITEM_KEYS), ("ri", "REFERENTIAL_INTEGRITY", STAR[:-1], _KEYS), ("unknown", "UNKNOWN_MEMBER", STAR[:-1], _ITEM_KEYS),
    ("scd2", "SCD2_INVARIANT", STAR[:1], ()), ("measures", "MEASURE", DIMENSIONS, ()),
):
    QUERIES[f"quality_{_name}"] = _check(_kind, _save, _columns)


@query
def quality_gate_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of all 49 checks, as the operational query shows it."""
    columns = (*_ITEM_KEYS, "quantity", "gross_amount", "discount_amount", "net_amount")
    log = checks.evaluated(checks.warehouse_checks(star_counted(spark, sf_dir, STAR, columns))).withColumnRenamed("failed_rows", "failed_row_count")
    return as_long(sql_over(spark, {"quality_audit": log}, OPERATIONS["quality_gate_log"]))


@query
def warehouse_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_long(checks.reconciled(star(spark, sf_dir)["fact_sales"], frame(spark, sf_dir, "c_order_items")))


# sinks and versioned tables, in a folder of the session's shared directory


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


def _written(spark: SparkSession, name: str, df: DataFrame) -> DataFrame:
    """``df`` computed once, as Parquet in the shared folder."""
    path = _place(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _story(spark: SparkSession, sf_dir: str) -> VersionedTable:
    """Orders, appended to by their later states under keys of their own, evolved by customers, updated and merged."""
    t = VersionedTable(spark, _place(spark, "story"))
    orders = source(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("bigint").alias("k"), F.col("o_orderpriority").alias("name"))
    people = source(spark, sf_dir, "customer").select((F.col("c_custkey") + PEOPLE).alias("k"), F.col("c_name").alias("name"))
    makers = source(spark, sf_dir, "supplier").select((F.col("s_suppkey") + MAKERS).alias("k"), F.col("s_name").alias("name"))
    t.overwrite(orders)
    t.append(orders.select((-F.col("k")).alias("k"), F.lit("later").alias("name")))
    t.append(people.withColumn("extra", F.lit("new")), merge_schema=True)
    t.update(F.col("name") == "1-URGENT", {"name": F.lower("name")})
    t.merge(people.unionByName(makers).select("k", F.concat(F.lit("m-"), "name").alias("name"), F.lit("merged").alias("extra")), "k")
    return t


#: Where the keys of customers and suppliers begin, beyond those of orders.
PEOPLE, MAKERS = 10**12, 2 * 10**12


@query
def time_travel_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as of the moment of its second commit."""
    t = _story(spark, sf_dir)
    return t.read(as_of=t.entry(1)["timestamp"])


@query
def partitioned_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written in folders by type and read back: counts by folder."""
    path = _place(spark, "events")
    write(source(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), path, ("event_type",))
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("sum_ids"), F.min("user_id").alias("least_user"))


def _delivered(spark: SparkSession, sf_dir: str, name: str, file_format: str) -> str:
    """A raw dataset as files of text, as it would be delivered."""
    path = _place(spark, name)
    df = frame(spark, sf_dir, f"r_{name}").drop("_ingested_timestamp")
    df.write.json(path) if file_format == "json" else df.write.option("header", "true").csv(path)
    return path


#: The moments of ingestion in the raw tables, and the run that delivers what came in then.
DELIVERIES = (("2024-01-01", "first"), ("2024-01-02", "second"))


def _ingested(spark: SparkSession, sf_dir: str, names: Iterable[str]) -> str:
    """Bronze of raw datasets that were landed as text files in two deliveries; the root of its tables.

    Each delivery is discovered and ingested, and ingested again, first with its audit and then without, as after a crash
    between the two commits.
    """
    root = _place(spark, "medallion")
    for day, run in DELIVERIES:
        landing = f"{root}/landing-{run}"
        for name in names:
            raw = frame(spark, sf_dir, f"r_{name}")
            mine = raw.where(F.to_date("_ingested_timestamp") == day).drop("_ingested_timestamp")
            path = f"{landing}/retail/{name}/ingestion_date={day}/run_id={run}"
            if DATASETS[name].file_format == "json":
                mine.write.json(path)
            else:
                mine.write.option("header", "true").csv(path)
        files, at = discover(spark, landing), datetime.fromisoformat(f"{day}T00:00:00+00:00")
        ingest_bronze(spark, root, files, at=at)
        again = [ingest_bronze(spark, root, files, at=at)]
        audit = audit_table(spark, root)
        audit.overwrite(audit.read(audit.latest()).where(F.col("ingestion_date") != day))
        again.append(ingest_bronze(spark, root, files, at=at))
        if any(n for added in again for n in added.values()):
            raise ValueError(f"files were ingested twice: {again}")
    return root


@query
def landing_to_bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of Bronze by delivery, and how many of them come from a file that the audit has."""
    root = _ingested(spark, sf_dir, ORDER)
    audited = audit_table(spark, root).read().where("status = 'SUCCESS'").select(F.col("ingestion_id").alias("_id"), F.col("dataset_name").alias("_dataset"))

    def one(name: str) -> DataFrame:
        rows = load(spark, root, "bronze", name).groupBy("_ingestion_id", "_ingestion_date", "_adf_run_id").agg(F.count("*").alias("n"))
        rows = rows.join(audited.where(F.col("_dataset") == name), F.col("_ingestion_id") == F.col("_id"), "left")
        rows = rows.groupBy(F.col("_ingestion_date").alias("ingestion_date"), F.col("_adf_run_id").alias("run_id")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("_id").isNotNull(), F.col("n"))).alias("audited"))
        return rows.withColumn("dataset_name", F.lit(name))

    return reduce(DataFrame.unionByName, map(one, ORDER))


@query
def silver_from_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of the landed rows of customers, products, stores and employees: the Silver tables by delivery and reason."""
    names = ("customers", "products", "stores", "employees")
    root = _ingested(spark, sf_dir, names)
    build_silver(spark, root, names=names)

    def one(name: str) -> DataFrame:
        good = load(spark, root, "silver", name).select("_ingestion_date", F.lit("VALID").alias("reason"))
        bad = load(spark, root, "silver", f"{name}_quarantine").select("_ingestion_date", F.col("quarantine_reason").alias("reason"))
        return good.unionByName(bad).groupBy(F.col("_ingestion_date").alias("ingestion_date"), "reason").agg(F.count("*").alias("n")).withColumn("dataset_name", F.lit(name))

    return reduce(DataFrame.unionByName, map(one, names))


@query
def silver_merge_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a second delivery merged into Silver: known ones take what is delivered, others are added."""
    root = _place(spark, "medallion")
    merge_customers(spark, root, frame(spark, sf_dir, "c_customers").where("cast(substring(customer_id, 6) as int) % 100 <> 0"))
    merge_customers(spark, root, frame(spark, sf_dir, "c_customers_next"))
    return load(spark, root, "silver", "customers").select("customer_id", "address", "loyalty_tier")


@query
def scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as CSV under the declared schema: columns that are not delivered are NULL."""
    df = scan(spark, _delivered(spark, sf_dir, "orders", "csv"), DATASETS["orders"])
    return df.groupBy(F.coalesce("order_status", F.lit("-")).alias("status")).agg(F.count("*").alias("n"), F.count("order_id").alias("ids"), F.count("total_amount").alias("totals"))


@query
def scan_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as JSON Lines, with all their columns as text."""
    df = scan_as_text(spark, _delivered(spark, sf_dir, "customers", "json"), "json")
    return df.groupBy(F.coalesce("loyalty_tier", F.lit("-")).alias("tier")).agg(F.count("*").alias("n"), F.count("email").alias("emails"))


@query
def fact_upsert_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts upserted, upserted again in a state where every discount is gone, and a third time as they were.

    The grain is an item and a key of its product, as an id that several products share gives an item several rows.
    """
    facts = star(spark, sf_dir)["fact_sales"]
    t = VersionedTable(spark, _place(spark, "fact_sales"))
    grain = ("order_item_id", "product_key")
    t.merge(facts, grain)
    once = t.read()
    t.merge(once.withColumn("discount_amount", F.lit(0).cast(once.schema["discount_amount"].dataType)), grain)
    t.merge(t.read(version=0), grain)
    return as_long(t.read())


@query
def time_travel_v0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _story(spark, sf_dir).read(version=0)


@query
def schema_evolved_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _story(spark, sf_dir).read(version=2)


@query
def update_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _story(spark, sf_dir).read(version=3)


@query
def named_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same version through the data source, as a session would read it that knows nothing of this library."""
    enable(spark)
    return spark.read.format("millrace").options(path=_story(spark, sf_dir).path, version=3).load()


@query
def merge_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _story(spark, sf_dir).read()


#: Files of a table that is to be merged into, enough for it to have an index.
MERGED_FILES = 24


@query
def indexed_merge_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in files by key, merged with a later state of some and with keys that are new: files without such a key stay unopened."""
    t = VersionedTable(spark, _place(spark, "orders"))
    orders = source(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("total"))
    t.overwrite(orders.repartitionByRange(MERGED_FILES, "o_orderkey"))
    late = orders.where("o_orderkey % 100 = 0").withColumn("o_orderstatus", F.lit("X"))
    new = source(spark, sf_dir, "customer").where("c_custkey % 100 = 0").select((F.col("c_custkey") + PEOPLE).cast("bigint").alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), F.col("c_acctbal").cast("decimal(18,2)").alias("total"))
    t.merge(new, "o_orderkey")
    t.merge(late, "o_orderkey")
    return t.read()


@query
def history_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _story(spark, sf_dir).history().select("version", "operation", "rows_added")


# ingestion and operations


@query
def ingest_pending_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as landed files, of which some are in the audit by id or by path."""
    e = source(spark, sf_dir, "events").select("event_id", "event_type")
    path = F.concat(F.lit("retail/"), "event_type", F.lit("/"), F.col("event_id").cast("string"))
    files = e.select("event_id", F.sha2(F.concat_ws("|", F.lower("event_type"), F.lower(path), F.lit("")), 256).alias("ingestion_id"), path.alias("source_path"))
    audit = files.where("event_id % 3 = 0").select("ingestion_id", F.lit("elsewhere").alias("source_path"), F.lit("SUCCESS").alias("status"))
    audit = audit.unionByName(files.where("event_id % 5 = 0").select(F.lit("other").alias("ingestion_id"), "source_path", F.when(F.col("event_id") % 10 == 0, "FAILED").otherwise("SUCCESS").alias("status")))
    return pending(files, audit).select("event_id", "ingestion_id")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One audit row per order priority and year."""
    o = source(spark, sf_dir, "orders").withColumn("d", F.col("o_orderdate").cast("date"))
    bad = F.count_if(F.col("o_orderstatus") == "P")
    runs = o.groupBy(F.year("d").alias("y"), F.col("o_orderpriority").alias("p")).agg(F.count("*").alias("n"), bad.alias("bad"))
    rate = F.col("bad").cast("double") / F.col("n").cast("double")
    return runs.select(
        F.concat_ws("-", F.col("y").cast("string"), "p").alias("orchestration_run_id"), F.lit("dev").alias("environment"), F.when(rate > 0.2, "FAILED").otherwise("SUCCESS").alias("final_status"),
        F.make_date("y", F.lit(1), F.lit(1)).cast("timestamp").alias("started_at"), F.lit(1.0).alias("duration_seconds"), F.col("n").alias("bronze_rows_ingested"), (F.col("n") - F.col("bad")).alias("silver_valid_rows"),
        F.col("bad").alias("silver_quarantine_rows"), F.round(rate, 6).alias("quarantine_rate"), F.lit(None).cast("string").alias("failure_task"), F.lit(None).cast("string").alias("failure_classification"),
        F.col("y").cast("string").alias("ingestion_date"), (rate > 0.2).alias("quarantine_alert_triggered"),
    )


@query
def run_audit_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_long(sql_over(spark, {"job_run_audit": _runs(spark, sf_dir)}, OPERATIONS["run_audit_latest"]))


@query
def quarantine_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_long(sql_over(spark, {"job_run_audit": _runs(spark, sf_dir)}, OPERATIONS["quarantine_trend"]))


@query
def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text that holds JSON, typed without errors."""
    k = F.get_json_object("props", "$.k")
    return source(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k.try_cast("bigint")).alias("sum_k"), F.count(money(k)).alias("n"))
