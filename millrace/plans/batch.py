"""The file pipeline: CSV and JSON Lines to clean Parquet, quarantine, metrics, curated sales and SQL reports."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from millrace.operators.checks import METRIC_SCHEMA
from millrace.operators.conform import Conformed, ReconciliationError, conform
from millrace.operators.curate import curated_sales, summed_by_order
from millrace.operators.rules import BATCH, ORDER
from millrace.plans.serving import REPORTS
from millrace.sources.files import scan, write
from millrace.sources.landing import joined_uri
from millrace.sources.schema import DATASETS


@dataclass(frozen=True)
class Metric:
    dataset_name: str
    source_row_count: int
    valid_row_count: int
    quarantine_row_count: int
    duplicate_count: int
    null_mandatory_count: int
    referential_orphan_count: int

    @classmethod
    def of(cls, name: str, reasons: dict[str | None, int]) -> Metric:
        """From rows by reason, so that one pass over the data gives all counters."""
        total = sum(reasons.values())
        valid = reasons.get(None, 0)

        def starting(text: str) -> int:
            return sum(n for r, n in reasons.items() if r and r.startswith(text))

        return cls(name, total, valid, total - valid, starting("DUPLICATE"), starting("NULL_MANDATORY"), starting("ORPHAN"))


def metrics_frame(spark: SparkSession, metrics: list[Metric]) -> DataFrame:
    at = datetime.now(UTC)
    return spark.createDataFrame([(*vars(m).values(), at) for m in metrics], METRIC_SCHEMA)


def assert_metrics(metrics: list[Metric]) -> None:
    for m in metrics:
        if m.source_row_count != m.valid_row_count + m.quarantine_row_count:
            raise ReconciliationError(str(m))


def conform_all(raw: dict[str, DataFrame]) -> dict[str, Conformed]:
    out: dict[str, Conformed] = {}
    for name in ORDER:
        spec = BATCH[name]
        out[name] = conform(raw[name], spec, {p.parent: out[p.parent].valid for p in spec.parents})
    return out


def run_batch(spark: SparkSession, source: str, target: str) -> dict[str, Metric]:
    """Reads ``<source>/<dataset>.csv|.json``, writes clean, quarantine, curated and metrics below ``target``."""
    clean: dict[str, DataFrame] = {}
    metrics = []
    for name in ORDER:
        spec, d = BATCH[name], DATASETS[name]
        both = conform(scan(spark, joined_uri(source, f"{name}.{d.file_format}"), d), spec, {p.parent: clean[p.parent] for p in spec.parents})
        rows, counted = both.observed()
        write(rows, joined_uri(target, "clean", name))
        write(both.quarantine, joined_uri(target, "quarantine", name))
        clean[name] = spark.read.parquet(joined_uri(target, "clean", name))
        metrics.append(Metric.of(name, counted()))
    assert_metrics(metrics)
    write(curated_sales(clean["orders"], clean["order_items"], clean["products"], clean["customers"], clean["stores"]), joined_uri(target, "curated", "sales"), ("order_year", "order_month"))
    write(metrics_frame(spark, metrics), joined_uri(target, "metrics"))
    return {m.dataset_name: m for m in metrics}


def register_views(spark: SparkSession, target: str) -> None:
    """v_curated_sales, v_order_totals and v_<dataset> for the reports."""
    lines = spark.read.parquet(joined_uri(target, "curated", "sales"))
    lines.createOrReplaceTempView("v_curated_sales")
    summed_by_order(lines).createOrReplaceTempView("v_order_totals")
    for name in ORDER:
        spark.read.parquet(joined_uri(target, "clean", name)).createOrReplaceTempView(f"v_{name}")


def run_reports(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: spark.sql(sql) for name, sql in REPORTS.items()}


def run_sql_files(spark: SparkSession, folder: str) -> dict[str, int]:
    """Rows of each ``*.sql`` file of a folder, in order of name; the first error ends the run."""
    return {p.name: spark.sql(p.read_text().rstrip().rstrip(";")).count() for p in sorted(Path(folder).glob("*.sql"))}
