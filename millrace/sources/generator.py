"""Dirty retail deliveries, made set-based: each value is a hash of seed, row and column, so runs agree at any size."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.sources.landing import joined_uri
from millrace.sources.schema import DATASETS


@dataclass(frozen=True)
class Scale:
    customers: int
    products: int
    stores: int
    employees: int
    orders: int
    max_items: int


# Sizes of the presets, defect rates, and the words that the data is made of.
SCALES = {"sample": Scale(25, 10, 3, 5, 50, 3), "small": Scale(500, 50, 10, 50, 2000, 4), "standard": Scale(50_000, 2000, 100, 1000, 200_000, 5)}
RATES = {"duplicate_rows": 0.015, "duplicate_keys": 0.010, "null_mandatory": 0.020, "casing": 0.050, "malformed_date": 0.015, "bad_quantity": 0.015, "bad_price": 0.010, "orphan": 0.020, "bad_email": 0.020, "bad_status": 0.015, "unreconciled": 0.025}
FIRST = ("James", "Mary", "Robert", "Linda", "David", "Susan", "Carlos", "Mei")
LAST = ("Smith", "Jones", "Brown", "Garcia", "Miller", "Davis", "Lee", "Khan")
TIERS = ("STANDARD", "SILVER", "GOLD", "PLATINUM")
STATES = ("CA", "NY", "TX", "FL", "WA", "IL")
REGIONS = ("West", "South", "East", "Central")
CATEGORIES = ("Electronics", "Apparel", "Home", "Sports")
CHANNELS = ("IN_STORE", "WEB", "MOBILE_APP")
STATUSES = ("COMPLETED", "PENDING", "CANCELLED", "REFUNDED")
METHODS = ("CREDIT_CARD", "DEBIT_CARD", "PAYPAL", "APPLE_PAY", "CASH")
REASONS = ("DEFECTIVE", "WRONG_SIZE", "UNSATISFIED", "NOT_AS_DESCRIBED", "ORDERED_BY_MISTAKE")


class Draw:
    """Pseudo-random columns of a table: a number in [0, 1) for each row and name."""

    def __init__(self, seed: int, table: str):
        self.seed, self.table = seed, table

    def u(self, name: str) -> Column:
        return F.pmod(F.xxhash64(F.col("id"), F.lit(f"{self.seed}/{self.table}/{name}")), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def n(self, name: str, low: int, high: int) -> Column:
        return (F.floor(self.u(name) * (high - low + 1)) + low).cast("int")

    def pick(self, name: str, words: tuple[str, ...]) -> Column:
        return F.element_at(F.array(*map(F.lit, words)), self.n(name, 1, len(words)))

    def hit(self, rate: str) -> Column:
        return self.u(f"defect-{rate}") < RATES[rate]

    def date(self, name: str) -> Column:
        good = F.date_format(F.date_add(F.lit("2022-01-01").cast("date"), self.n(name, 0, 1000)), "yyyy-MM-dd")
        return F.when(self.hit("malformed_date"), F.element_at(F.array(F.lit("2023-99-99"), F.lit("INVALID_DATE")), self.n("which", 1, 2))).otherwise(good)

    def time(self, name: str) -> Column:
        at = F.lit("2023-01-01 00:00:00").cast("timestamp").cast("long") + self.n(name, 0, 60_000_000)
        return F.date_format(at.cast("timestamp"), "yyyy-MM-dd HH:mm:ss")


def _code(prefix: str, n: Column, width: int) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.lpad(n.cast("string"), width, "0"))


def _cents(c: Column) -> Column:
    return c.cast("decimal(12,2)").cast("string")


def _price(product: Column) -> Column:
    return (F.pmod(F.xxhash64(product, F.lit("price")), F.lit(19000)) / 100 + 10).cast("decimal(10,2)")


def tables(spark: SparkSession, scale: Scale | str = "small", seed: int = 42) -> dict[str, DataFrame]:
    """The eight datasets, all text, with about the given rates of each defect."""
    s = SCALES[scale] if isinstance(scale, str) else scale
    out: dict[str, DataFrame] = {}

    def rows(n: int) -> DataFrame:
        return spark.range(1, n + 1)

    d = Draw(seed, "customers")
    messy = d.hit("casing")
    first, last = d.pick("first", FIRST), d.pick("last", LAST)
    email = F.when(d.hit("bad_email"), F.concat(F.lower(first), F.lit("_at_example_no_domain"))).otherwise(F.concat(F.lower(first), F.lit("."), F.col("id").cast("string"), F.lit("@example.com")))
    out["customers"] = rows(s.customers).select(
        F.when(d.hit("null_mandatory"), "").otherwise(_code("CUST", F.col("id"), 6)).alias("customer_id"), F.when(messy, F.concat(F.lit("  "), F.upper(first), F.lit("  "))).otherwise(first).alias("first_name"),
        F.when(messy, F.concat(F.lit(" "), F.lower(last), F.lit(" "))).otherwise(last).alias("last_name"), email.alias("email"), F.lit("555-0100").alias("phone"), F.concat(d.n("house", 1, 999).cast("string"), F.lit(" Main St")).alias("address"),
        F.lit("Springfield").alias("city"), F.when(messy, F.lit(" CA ")).otherwise(d.pick("state", STATES)).alias("state"), F.lit("US").alias("country"), F.lpad(d.n("zip", 1, 99999).cast("string"), 5, "0").alias("postal_code"), d.date("signup").alias("signup_date"), d.pick("tier", TIERS).alias("loyalty_tier"),
    )
    d = Draw(seed, "products")
    price = _price(F.col("id"))
    out["products"] = rows(s.products).select(
        F.when(d.hit("null_mandatory"), "").otherwise(_code("PROD", F.col("id"), 5)).alias("product_id"), F.concat(F.lit("SKU-"), F.col("id").cast("string")).alias("product_sku"), F.concat(F.lit("Product "), F.col("id").cast("string")).alias("product_name"),
        d.pick("category", CATEGORIES).alias("category"), F.lit("General").alias("subcategory"), F.when(d.hit("bad_price"), F.concat(F.lit("-"), price.cast("string"))).otherwise(price.cast("string")).alias("unit_price"), _cents(price * F.lit(0.6).cast("decimal(3,1)")).alias("cost_price"), F.lit("true").alias("is_active"), F.lit("").alias("description"),
    )
    d = Draw(seed, "stores")
    out["stores"] = rows(s.stores).select(_code("STR", F.col("id"), 4).alias("store_id"), F.concat(F.lit("Store "), F.col("id").cast("string")).alias("store_name"), F.lit("Mall").alias("store_type"), d.pick("region", REGIONS).alias("region"), d.pick("state", STATES).alias("state"), F.lit("US").alias("country"), F.lit("2015-06-01").alias("opened_date"))
    d = Draw(seed, "employees")
    out["employees"] = rows(s.employees).select(_code("EMP", F.col("id"), 5).alias("employee_id"), _code("STR", d.n("store", 1, s.stores), 4).alias("store_id"), d.pick("first", FIRST).alias("first_name"), d.pick("last", LAST).alias("last_name"), F.concat(F.lit("e"), F.col("id").cast("string"), F.lit("@shop.com")).alias("email"), F.lit("Clerk").alias("role"), F.lit("2021-03-01").alias("hire_date"), F.lit("true").alias("is_active"))
    d = Draw(seed, "orders")
    subtotal = (d.n("cents", 1000, 90000) / 100).cast("decimal(12,2)")
    total = (subtotal + F.lit("8.00").cast("decimal(12,2)")).cast("decimal(12,2)")
    orphan = d.hit("orphan")
    out["orders"] = rows(s.orders).select(
        _code("ORD", F.col("id"), 7).alias("order_id"), F.when(orphan & (d.u("kind") < 0.5), "CUST-999999").otherwise(_code("CUST", d.n("customer", 1, s.customers), 6)).alias("customer_id"), F.when(orphan & (d.u("kind") >= 0.5), "STR-9999").otherwise(_code("STR", d.n("store", 1, s.stores), 4)).alias("store_id"),
        _code("EMP", d.n("employee", 1, s.employees), 5).alias("employee_id"), F.when(d.hit("malformed_date"), "2024-02-31 25:61:99").otherwise(d.time("at")).alias("order_timestamp"), F.when(d.hit("bad_status"), "UNKNOWN_STATUS_INVALID").otherwise(d.pick("status", STATUSES)).alias("order_status"), d.pick("channel", CHANNELS).alias("channel"),
        F.lit("5.00").alias("shipping_cost"), F.lit("3.00").alias("tax_amount"), subtotal.cast("string").alias("order_subtotal"), total.cast("string").alias("total_amount"),
    )
    d = Draw(seed, "payments")
    paid = F.when(d.hit("unreconciled"), total + F.lit("25.00").cast("decimal(12,2)")).otherwise(total)
    out["payments"] = rows(s.orders).select(
        _code("PAY", F.col("id"), 7).alias("payment_id"), F.when(d.hit("orphan"), "ORD-9999999").otherwise(_code("ORD", F.col("id"), 7)).alias("order_id"), Draw(seed, "orders").time("at").alias("payment_timestamp"), d.pick("method", METHODS).alias("payment_method"),
        F.when(d.hit("bad_status"), "STATUS_UNKNOWN_INVALID").otherwise("SUCCESS").alias("payment_status"), paid.cast("decimal(12,2)").cast("string").alias("payment_amount"), F.concat(F.lit("TX"), F.col("id").cast("string")).alias("transaction_reference"),
    )
    d = Draw(seed, "items")
    lines = rows(s.orders).select(F.col("id").alias("o"), F.explode(F.sequence(F.lit(1), d.n("items", 1, s.max_items))).alias("k")).select("o", ((F.col("o") - 1) * s.max_items + F.col("k")).alias("id"))
    product = d.n("product", 1, s.products)
    out["order_items"] = lines.select(
        _code("ITEM", F.col("id"), 8).alias("order_item_id"), F.when(d.hit("orphan") & (d.u("kind") < 0.5), "ORD-9999999").otherwise(_code("ORD", F.col("o"), 7)).alias("order_id"), F.when(d.hit("orphan") & (d.u("kind") >= 0.5), "PROD-99999").otherwise(_code("PROD", product, 5)).alias("product_id"),
        F.when(d.hit("bad_quantity"), F.element_at(F.array(F.lit("-1"), F.lit("0")), d.n("which", 1, 2))).otherwise(d.n("quantity", 1, 5).cast("string")).alias("quantity"), _price(product.cast("long")).cast("string").alias("unit_price"), F.element_at(F.array(F.lit("0.00"), F.lit("0.05"), F.lit("0.10"), F.lit("0.15")), d.n("discount", 1, 4)).alias("discount_percent"),
    )
    d = Draw(seed, "returns")
    back = lines.where(d.u("returned") < 0.08)
    out["returns"] = back.select(_code("RET", F.col("id"), 7).alias("return_id"), F.when(d.hit("orphan"), "ITEM-99999999").otherwise(_code("ITEM", F.col("id"), 8)).alias("order_item_id"), d.time("at").alias("return_timestamp"), d.pick("reason", REASONS).alias("return_reason"), _cents(d.n("cents", 500, 9000) / 100).alias("refund_amount"), d.pick("status", ("APPROVED", "PENDING", "REJECTED")).alias("return_status"))
    return {n: _repeated(df, n, seed) for n, df in out.items()}


def _repeated(df: DataFrame, name: str, seed: int) -> DataFrame:
    """With some rows delivered twice, and some keys used again with other values."""
    if name in ("stores", "employees"):
        return df
    u = F.pmod(F.xxhash64(*df.columns, F.lit(f"{seed}/{name}/again")), F.lit(100_000)) / F.lit(100_000.0)
    key = df.columns[0]
    whole = df.where(u < RATES["duplicate_rows"])
    changed = df.where((u >= RATES["duplicate_rows"]) & (u < RATES["duplicate_rows"] + RATES["duplicate_keys"]) & (F.col(key) != ""))
    last = df.columns[-1]
    changed = changed.withColumn(last, F.concat(F.coalesce(F.col(last), F.lit("")), F.lit(" "))) if name not in ("orders", "order_items") else changed
    return df.unionByName(whole).unionByName(changed).select(*DATASETS[name].columns)


def write_files(spark: SparkSession, target: str, scale: Scale | str = "small", seed: int = 42) -> dict[str, str]:
    """One folder ``<dataset>.csv`` or ``<dataset>.json`` for each dataset."""
    out = {}
    for name, df in tables(spark, scale, seed).items():
        d = DATASETS[name]
        out[name] = joined_uri(target, f"{name}.{d.file_format}")
        writer = df.coalesce(1).write.mode("overwrite")
        writer.json(out[name]) if d.file_format == "json" else writer.option("header", "true").csv(out[name])
    return out


def seed_landing(spark: SparkSession, landing: str, ingestion_date: str, run_id: str | None = None, scale: Scale | str = "sample", seed: int = 42) -> str:
    """Delivers generated data to the landing zone, one file for each dataset, under the path contract."""
    run_id = run_id or uuid.uuid4().hex[:8]
    for name, df in tables(spark, scale, seed).items():
        d = DATASETS[name]
        folder = joined_uri(landing, "retail", name, f"ingestion_date={ingestion_date}", f"run_id={run_id}")
        writer = df.coalesce(1).write.mode("overwrite")
        writer.json(folder) if d.file_format == "json" else writer.option("header", "true").csv(folder)
    return run_id
