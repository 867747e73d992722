"""Quality checks, compiled to as few passes as there are tables, with gates and exact reconciliation."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from millrace.operators.dimensions import COPIES

CRITICAL, WARNING = "CRITICAL", "WARNING"
AUDIT_SCHEMA = "check_name string, table_name string, check_type string, severity string, passed boolean, observed_value string, expected_value string, failed_row_count int, execution_timestamp timestamp"
METRIC_SCHEMA = "dataset_name string, source_row_count long, valid_row_count long, quarantine_row_count long, duplicate_count long, null_mandatory_count long, referential_orphan_count long, calculated_at timestamp"


class QualityGateError(RuntimeError):
    """A critical check failed."""


class ReconciliationGateError(RuntimeError):
    """Warehouse totals are not those of the layer below."""


@dataclass(frozen=True)
class Check:
    """A count of failing rows of a table: ``value`` is an aggregate Column over ``df``."""

    name: str
    table: str
    kind: str
    df: DataFrame
    value: Column
    severity: str = CRITICAL
    allowed: bool = False


@dataclass(frozen=True)
class Result:
    check_name: str
    table_name: str
    check_type: str
    severity: str
    passed: bool
    observed_value: str
    expected_value: str
    failed_row_count: int


def counted(df: DataFrame, condition: Column | None = None) -> Column:
    """How many rows of ``df``, or those of them where a condition holds; a row with ``_copies`` counts as often as these say."""
    if COPIES not in df.columns:
        return F.count("*") if condition is None else F.count_if(condition)
    return F.coalesce(F.sum(F.col(COPIES) if condition is None else F.when(condition, F.col(COPIES))), F.lit(0))


def completeness(df: DataFrame, table: str, columns: Iterable[str]) -> list[Check]:
    return [Check(f"completeness_{c}", table, "COMPLETENESS", df, counted(df, F.col(c).isNull())) for c in columns]


def uniqueness(df: DataFrame, table: str, columns: list[str]) -> Check:
    """Rows beyond the first of each grain."""
    grain = df.groupBy(*columns).agg(counted(df).alias("n"))
    return Check(f"uniqueness_{'_'.join(columns)}", table, "UNIQUENESS", grain, F.coalesce(F.sum(F.col("n") - 1), F.lit(0)))


def referential(child: DataFrame, table: str, column: str, parent: DataFrame, key: str, allow_zero: bool = True) -> Check:
    """Child rows whose key is not in the parent; key 0 is another check's matter unless ``allow_zero`` is off."""
    rows = child.where(F.col(column) != 0) if allow_zero else child
    missing = rows.join(parent.select(F.col(key).alias("_key")), F.col(column) == F.col("_key"), "left_anti")
    return Check(f"referential_integrity_{column}", table, "REFERENTIAL_INTEGRITY", missing, counted(missing))


def unknown_members(df: DataFrame, table: str, columns: Iterable[str], allow: bool = False) -> list[Check]:
    return [Check(f"unknown_member_{c}", table, "UNKNOWN_MEMBER", df, counted(df, F.col(c) == 0), WARNING if allow else CRITICAL, allow) for c in columns]


def scd2_invariants(dim: DataFrame, table: str = "dim_customer") -> list[Check]:
    """One current version each; current ones are open; ended ones run forward; no two overlap."""
    current = dim.groupBy("customer_id").agg(counted(dim, F.col("is_current")).alias("n"))
    copies = COPIES in dim.columns
    before = F.lag("effective_to").over(Window.partitionBy("customer_id").orderBy("effective_from", *([F.col("effective_to").asc_nulls_first()] if copies else [])))
    overlap = dim.withColumn("_before", before)
    after = F.coalesce(F.col("effective_from") < F.col("_before"), F.lit(False))
    # copies of a row follow one another
    overlaps = F.sum(after.cast("bigint") + F.when(F.col("effective_from") < F.col("effective_to"), F.col(COPIES) - 1).otherwise(0)) if copies else F.count_if(after)
    kind = "SCD2_INVARIANT"
    return [
        Check("scd2_one_current", table, kind, current, F.count_if(F.col("n") != 1)),
        Check("scd2_current_open", table, kind, dim, counted(dim, F.col("is_current") & F.col("effective_to").isNotNull())),
        Check("scd2_ended_forward", table, kind, dim, counted(dim, ~F.col("is_current") & (F.col("effective_to").isNull() | (F.col("effective_from") >= F.col("effective_to"))))),
        Check("scd2_no_overlap", table, kind, overlap, F.coalesce(overlaps, F.lit(0))),
    ]


def measures(df: DataFrame, table: str = "fact_sales") -> list[Check]:
    return [
        Check("positive_quantity", table, "MEASURE", df, counted(df, ~F.coalesce(F.col("quantity") > 0, F.lit(False)))),
        Check("net_is_gross_less_discount", table, "MEASURE", df, counted(df, F.col("net_amount") != F.col("gross_amount") - F.col("discount_amount"))),
    ]


def evaluated(checks: list[Check]) -> DataFrame:
    """(check_name, table_name, check_type, severity, failed_rows, passed): checks over one DataFrame share a pass."""
    groups: dict[int, list[Check]] = {}
    for c in checks:
        groups.setdefault(id(c.df), []).append(c)
    parts = []
    for group in groups.values():
        row = group[0].df.agg(*(c.value.cast("long").alias(f"v{k}") for k, c in enumerate(group)))
        cells = [F.struct(F.lit(c.name).alias("check_name"), F.lit(c.table).alias("table_name"), F.lit(c.kind).alias("check_type"), F.lit(c.severity).alias("severity"), F.col(f"v{k}").alias("failed_rows"), F.lit(c.allowed).alias("allowed")) for k, c in enumerate(group)]
        parts.append(row.select(F.explode(F.array(*cells)).alias("r")).select("r.*"))
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumn("passed", F.col("allowed") | (F.col("failed_rows") == 0)).drop("allowed")


def suite(checks: list[Check], fail: bool = True) -> list[Result]:
    """Results of all checks in one job; raises on a critical one that failed."""
    rows = evaluated(checks).collect()
    out = [Result(r["check_name"], r["table_name"], r["check_type"], r["severity"], r["passed"], f"{r['failed_rows']} failing rows", "0 failing rows", int(r["failed_rows"])) for r in rows]
    bad = [r for r in out if not r.passed and r.severity == CRITICAL]
    if fail and bad:
        raise QualityGateError("; ".join(f"{r.table_name}.{r.check_name}: {r.observed_value}" for r in bad))
    return out


def warehouse_checks(t: dict[str, DataFrame], allow_unknown: bool = False, kind: str | None = None) -> list[Check]:
    """The 49 checks of the star schema, or those of one ``kind``: then the facts need only the columns that these look at."""
    date, cust, prod, store, sales, back = (t[n] for n in ("dim_date", "dim_customer", "dim_product", "dim_store", "fact_sales", "fact_returns"))
    keys = ["customer_key", "product_key", "store_key", "order_date_key"]
    wanted = kind in (None, "UNIQUENESS")  # the only checks that ask for columns as soon as they are made
    found = [
        *completeness(prod, "dim_product", ["product_key", "product_id", "product_name"]),
        *(uniqueness(prod, "dim_product", [c]) for c in ("product_key", "product_id") if wanted),
        *completeness(store, "dim_store", ["store_key", "store_id", "store_name"]),
        *(uniqueness(store, "dim_store", [c]) for c in ("store_key", "store_id") if wanted),
        *completeness(date, "dim_date", ["date_key", "full_date", "year", "month"]),
        *(uniqueness(date, "dim_date", [c]) for c in ("date_key",) if wanted),
        *completeness(cust, "dim_customer", ["customer_key", "customer_id", "effective_from", "is_current"]),
        *(uniqueness(cust, "dim_customer", [c]) for c in ("customer_key",) if wanted),
        *scd2_invariants(cust),
        *completeness(sales, "fact_sales", ["order_item_id", *keys, "net_amount"]),
        *(uniqueness(sales, "fact_sales", [c]) for c in ("order_item_id",) if wanted),
        *completeness(back, "fact_returns", ["return_id", "order_item_id", "refund_amount"]),
        *(uniqueness(back, "fact_returns", [c]) for c in ("return_id",) if wanted),
        referential(sales, "fact_sales", "product_key", prod, "product_key"),
        referential(sales, "fact_sales", "store_key", store, "store_key"),
        referential(sales, "fact_sales", "customer_key", cust, "customer_key"),
        referential(sales, "fact_sales", "order_date_key", date, "date_key"),
        *unknown_members(sales, "fact_sales", keys, allow_unknown),
        *unknown_members(back, "fact_returns", ["customer_key", "product_key", "store_key", "return_date_key"], allow_unknown),
        *measures(sales),
    ]
    return [c for c in found if kind in (None, c.kind)]


def audit_rows(spark: SparkSession, results: list[Result], at: datetime | None = None) -> DataFrame:
    at = at or datetime.now(UTC)
    return spark.createDataFrame([(r.check_name, r.table_name, r.check_type, r.severity, r.passed, r.observed_value, r.expected_value, r.failed_row_count, at) for r in results], AUDIT_SCHEMA)


def totals(df: DataFrame, quantity: str, price: str) -> DataFrame:
    """Rows and exact sums of gross, discount and net."""
    gross = (F.col(quantity).cast("int") * F.col(price)).cast("decimal(10,2)")
    return df.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).cast("decimal(18,2)").alias(a) for c, a in ((gross, "gross"), (F.col("discount_amount"), "discount"), (F.col("net_amount"), "net"))))


def reconciled(sales: DataFrame, items: DataFrame) -> DataFrame:
    """One row: each total of the fact and of the items, and whether all agree exactly."""
    f = totals(sales, "quantity", "unit_price").select(*(F.col(c).alias(f"fact_{c}") for c in ("n", "gross", "discount", "net")))
    s = totals(items, "quantity", "unit_price").select(*(F.col(c).alias(f"source_{c}") for c in ("n", "gross", "discount", "net")))
    same = reduce(lambda a, b: a & b, (F.col(f"fact_{c}") == F.col(f"source_{c}") for c in ("n", "gross", "discount", "net")))
    return f.join(s, F.lit(True)).withColumn("reconciled", same)


def assert_reconciled(sales: DataFrame, items: DataFrame) -> dict:
    row = reconciled(sales, items).first().asDict()
    if not row["reconciled"]:
        raise ReconciliationGateError(str(row))
    return row


def quarantine_rate(valid: int, rejected: int) -> float:
    return rejected / (valid + rejected) if valid + rejected else 0.0
