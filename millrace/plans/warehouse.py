"""The star schema over versioned tables: dimensions, point-in-time facts, the quality gate and reconciliation."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.operators import checks, dimensions as dims
from millrace.plans.layers import load
from millrace.sources.landing import joined_uri
from millrace.sources.versioned import VersionedTable

TABLES = ("dim_date", "dim_store", "dim_product", "dim_employee", "dim_customer", "fact_sales", "fact_returns", "quality_audit")


def table(spark: SparkSession, root: str, name: str) -> VersionedTable:
    return VersionedTable(spark, joined_uri(root, "warehouse", name))


def _type1(t: VersionedTable, incoming, build, natural: str, surrogate: str, always: bool = False) -> None:
    """Members whose attributes differ are overwritten, or ``always`` all that are delivered; keys stay."""
    if not t.exists():
        t.overwrite(build(incoming, None))
        return
    existing = t.read()
    attributes = [c for c in existing.columns if c not in (natural, surrogate)]
    t.merge(build(incoming, existing), natural, None if always else lambda a, b: dims.changed(a, b, attributes), keep=(surrogate,))


def upsert_customers(t: VersionedTable, customers: DataFrame, at: datetime, history_start: datetime) -> str:
    """Creates or advances the type 2 history in one commit; says which, or that nothing changed.

    Only files with a version that ends are rewritten; those that hold no current version of a changed customer are not opened for it.
    """
    if not t.exists():
        t.overwrite(dims.scd2_initial(customers, history_start))
        return "created"
    base = t.latest()
    batch = dims.scd2_batch(t.read(base), customers, at)
    if batch is None:
        return "unchanged"
    ended, versions = batch
    t.revise(ended, "customer_id", "is_current", dims.ending(at), versions, "SCD2", base)
    return "advanced"


def build_warehouse(spark: SparkSession, root: str, at: datetime | None = None, allow_unknown: bool = False) -> dict[str, int]:
    """All dimensions and facts from Silver, then the 49 checks and exact reconciliation; raises if a gate fails."""
    at = at or datetime.now(UTC)
    silver = {n: load(spark, root, "silver", n) for n in ("customers", "products", "stores", "employees", "orders", "order_items", "returns")}
    t = {n: table(spark, root, n) for n in TABLES}
    earliest = silver["orders"].agg(F.min("order_timestamp")).first()[0]
    if not t["dim_date"].exists():
        t["dim_date"].overwrite(dims.dim_date(spark))
    _type1(t["dim_product"], silver["products"], dims.dim_product, "product_id", "product_key")
    _type1(t["dim_store"], silver["stores"], dims.dim_store, "store_id", "store_key")
    stores = t["dim_store"].read()
    _type1(t["dim_employee"], silver["employees"], lambda e, x: dims.dim_employee(e, stores, x), "employee_id", "employee_key")
    upsert_customers(t["dim_customer"], silver["customers"], at, earliest or at)
    d = {n: t[n].read() for n in ("dim_date", "dim_store", "dim_product", "dim_customer")}
    t["fact_sales"].merge(dims.fact_sales(silver["order_items"], silver["orders"], d["dim_customer"], d["dim_product"], d["dim_store"], d["dim_date"]), "order_item_id")
    t["fact_returns"].merge(dims.fact_returns(silver["returns"], t["fact_sales"].read(), d["dim_date"]), "return_id")
    now = {n: t[n].read() for n in TABLES if n != "quality_audit"}
    results = checks.suite(checks.warehouse_checks(now, allow_unknown), fail=False)
    t["quality_audit"].append(checks.audit_rows(spark, results, at))
    bad = [r for r in results if not r.passed and r.severity == checks.CRITICAL]
    if bad:
        raise checks.QualityGateError("; ".join(f"{r.table_name}.{r.check_name}: {r.observed_value}" for r in bad))
    checks.assert_reconciled(now["fact_sales"], silver["order_items"])
    return {n: df.count() for n, df in now.items()}
