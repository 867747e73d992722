"""A small job graph: retries for passing faults only, skips below a failure, one audit row per run."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.utils import AnalysisException

from millrace.operators.checks import QualityGateError, ReconciliationGateError, quarantine_rate
from millrace.operators.conform import ReconciliationError
from millrace.operators.dimensions import TemporalOrderError
from millrace.plans import layers, warehouse
from millrace.functions.secrets import redacted
from millrace.sources.landing import LandingIncompleteError, LandingPathError, assert_complete, discover, joined_uri
from millrace.sources.schema import DATASETS
from millrace.sources.versioned import ConcurrentCommitError, SchemaMismatchError, TableNotFoundError, VersionedTable

TRANSIENT, DATA_QUALITY, CONFIGURATION, DEPENDENCY, UNKNOWN = "TRANSIENT", "DATA_QUALITY", "CONFIGURATION", "DEPENDENCY", "UNKNOWN"
SUCCESS, FAILED, SKIPPED = "SUCCESS", "FAILED", "SKIPPED"


class QuarantineRateError(RuntimeError):
    """More rows were rejected than the run allows."""


class FinalGateError(RuntimeError):
    """The values that the tasks published do not add up to a good run."""


class UpstreamError(RuntimeError):
    """A task that this one needs did not succeed."""


def classify(error: BaseException) -> str:
    """The failure class, which decides on retries: only passing faults are tried again."""
    if isinstance(error, (QualityGateError, ReconciliationGateError, ReconciliationError, TemporalOrderError, QuarantineRateError, FinalGateError, SchemaMismatchError)):
        return DATA_QUALITY
    if isinstance(error, (UpstreamError, LandingIncompleteError)):
        return DEPENDENCY
    if isinstance(error, TableNotFoundError):
        return CONFIGURATION
    if isinstance(error, (ConnectionError, TimeoutError, ConcurrentCommitError, OSError)):
        return TRANSIENT
    if isinstance(error, (LandingPathError, ValueError, KeyError, TypeError, AnalysisException)):
        return CONFIGURATION
    text = str(error).lower()
    if any(w in text for w in ("timeout", "timed out", "connection", "throttl", "temporarily unavailable", "503", "429")):
        return TRANSIENT
    return UNKNOWN


@dataclass(frozen=True)
class RetryPolicy:
    retries: int = 1
    delay: float = 0.05

    def run(self, action: Callable[[], Any]) -> tuple[Any, int]:
        """(result, retries used)."""
        used = 0
        while True:
            try:
                return action(), used
            except Exception as e:
                if classify(e) != TRANSIENT or used >= self.retries:
                    e.retries = used  # type: ignore[attr-defined]
                    raise
                used += 1
                time.sleep(self.delay)


class TaskValues:
    """Small values that tasks publish for later ones."""

    def __init__(self):
        self._lock, self._values = threading.Lock(), {}

    def set(self, task: str, key: str, value: Any) -> None:
        with self._lock:
            self._values.setdefault(task, {})[key] = value

    def get(self, task: str, key: str, default: Any = None) -> Any:
        with self._lock:
            return self._values.get(task, {}).get(key, default)


@dataclass
class Run:
    """Settings and state of one run. A run id of None takes any delivery of the date."""

    spark: SparkSession
    landing: str
    root: str
    ingestion_date: str
    run_id: str | None = None
    environment: str = "dev"
    threshold: float = 0.20
    allow_unknown: bool = False
    supersede: bool = False
    orchestration_run_id: str = field(default_factory=lambda: f"run-{uuid.uuid4().hex[:12]}")
    job_id: str = "local"
    job_run_id: str = "local"
    started: datetime = field(default_factory=lambda: datetime.now(UTC))
    values: TaskValues = field(default_factory=TaskValues)
    tasks: tuple[str, ...] = ()


@dataclass
class Outcome:
    task: str
    state: str
    seconds: float = 0.0
    retries: int = 0
    failure: str | None = None
    message: str | None = None


@dataclass(frozen=True)
class Task:
    name: str
    action: Callable[[Run], None]
    needs: tuple[str, ...] = ()
    always: bool = False


def validate_landing(run: Run) -> None:
    files = discover(run.spark, run.landing)
    run.values.set("validate_landing", "datasets", len(assert_complete(files, run.ingestion_date, run.run_id)))


def bronze(run: Run) -> None:
    files = [f for f in discover(run.spark, run.landing) if f.ingestion_date == run.ingestion_date and run.run_id in (None, f.run_id)]
    run.values.set("bronze", "rows", sum(layers.ingest_bronze(run.spark, run.root, files).values()))


def silver(run: Run) -> None:
    """Publishes counts before the gate, so that a failed run still tells them."""
    counts = layers.build_silver(run.spark, run.root, run.supersede)
    valid, rejected, again = (sum(c[k] for c in counts.values()) for k in ("valid", "quarantine", "redelivered"))
    rate = quarantine_rate(valid, rejected - again)
    for key, value in (("valid", valid), ("quarantine", rejected), ("redelivered", again), ("rate", rate), ("alert", rate > run.threshold)):
        run.values.set("silver", key, value)
    if rate > run.threshold:
        raise QuarantineRateError(f"quarantine rate {rate:.4f} is over {run.threshold}")


def gold(run: Run) -> None:
    run.values.set("gold", "tables", len(layers.build_gold(run.spark, run.root)))


def star(run: Run) -> None:
    rows = warehouse.build_warehouse(run.spark, run.root, allow_unknown=run.allow_unknown)
    run.values.set("warehouse", "fact_sales", rows["fact_sales"])
    run.values.set("warehouse", "quality", "PASSED")


def final_gate(run: Run) -> None:
    """What every layer published must add up; says all that does not."""
    v = run.values.get
    wrong = [
        what
        for what, bad in (
            ("landing: datasets are missing", v("validate_landing", "datasets") != len(DATASETS)),
            ("bronze: no count of rows", v("bronze", "rows") is None or v("bronze", "rows") < 0),
            ("silver: no valid rows", not v("silver", "valid")),
            ("silver: too many rejected rows", v("silver", "alert") is not False),
            ("gold: tables are missing", v("gold", "tables") != len(layers.KPI)),
            ("warehouse: checks did not pass", v("warehouse", "quality") != "PASSED"),
            ("warehouse: no facts", not v("warehouse", "fact_sales")),
        )
        if bad
    ]
    if wrong:
        raise FinalGateError("; ".join(wrong))


def publish_summary(run: Run) -> None:
    """Upserts the run's audit row from what the tasks published, so that a repaired run has one."""
    record_run(run)


TASKS = (
    Task("validate_landing", validate_landing),
    Task("bronze", bronze, ("validate_landing",)),
    Task("silver", silver, ("bronze",)),
    Task("gold", gold, ("silver",)),
    Task("warehouse", star, ("silver",)),
    Task("final_gate", final_gate, ("gold", "warehouse")),
)
#: Runs after all others, whatever became of them.
SUMMARY = Task("publish_summary", publish_summary, tuple(t.name for t in TASKS), always=True)
RUN_SCHEMA = """orchestration_run_id string, job_id string, job_run_id string, environment string, ingestion_date string, adf_run_id string, started_at timestamp, completed_at timestamp,
 final_status string, duration_seconds double, landing_ready boolean, discovered_dataset_count int, bronze_rows_ingested long, silver_valid_rows long,
 silver_quarantine_rows long, gold_tables_generated int, fact_sales_rows long, quality_status string, quarantine_rate double,
 quarantine_alert_triggered boolean, failure_task string, failure_classification string, error_message string"""


def ordered(tasks: tuple[Task, ...]) -> list[Task]:
    """Tasks after what they need; raises on unknown names and cycles."""
    by_name, out, open_ = {t.name: t for t in tasks}, [], list(tasks)
    if missing := {n for t in tasks for n in t.needs} - set(by_name):
        raise ValueError(f"unknown tasks: {sorted(missing)}")
    while open_:
        ready = [t for t in open_ if all(n in {o.name for o in out} for n in t.needs)]
        if not ready:
            raise ValueError(f"cycle among {[t.name for t in open_]}")
        out += ready
        open_ = [t for t in open_ if t not in ready]
    return out


def run_job(run: Run, tasks: tuple[Task, ...] = TASKS, policy: RetryPolicy = RetryPolicy()) -> dict[str, Outcome]:
    """Runs the graph, then the summary, which runs in any case. A failure skips what depends on it, and no more."""
    done: dict[str, Outcome] = {}
    run.tasks = tuple(t.name for t in ordered(tasks))
    for t in [*ordered(tasks), Task(SUMMARY.name, SUMMARY.action, run.tasks, always=True)]:
        blocked = [n for n in t.needs if done[n].state != SUCCESS]
        began = time.monotonic()
        if blocked and not t.always:
            out = Outcome(t.name, SKIPPED, failure=DEPENDENCY, message=f"{blocked} did not succeed")
        else:
            try:
                _, retries = policy.run(lambda t=t: t.action(run))
                out = Outcome(t.name, SUCCESS, time.monotonic() - began, retries)
            except Exception as e:
                out = Outcome(t.name, FAILED, time.monotonic() - began, getattr(e, "retries", 0), classify(e), redacted(str(e))[:2000])
        done[t.name] = out
        for key, value in (("state", out.state), ("failure", out.failure), ("message", out.message)):
            run.values.set(t.name, key, value)
    return done


def root_failure(done: dict[str, Outcome]) -> Outcome | None:
    """The first task that failed itself."""
    return next((o for o in done.values() if o.state == FAILED), None)


def root_cause(run: Run) -> tuple[str | None, str | None, str | None]:
    """(task, failure class, message) from what the tasks published: the first that failed, else the first that told no
    end, as one does whose machine went away. Skipped tasks are no cause. Nothing if all succeeded."""
    v = run.values.get
    for t in run.tasks:
        if v(t, "state") == FAILED:
            return t, v(t, "failure") or UNKNOWN, v(t, "message") or f"{t} failed"
    for t in run.tasks:
        if v(t, "state") is None:
            return t, UNKNOWN, f"{t} told no end: it was interrupted, or never began"
    return None, None, None


def record_run(run: Run) -> None:
    """Upserts the run's audit row, so that a repaired run has one."""
    cause, v, now = root_cause(run), run.values.get, datetime.now(UTC)
    row = (
        run.orchestration_run_id, run.job_id, run.job_run_id, run.environment, run.ingestion_date, run.run_id or "*", run.started, now, FAILED if cause[0] else SUCCESS,
        (now - run.started).total_seconds(), v("validate_landing", "state") == SUCCESS, v("validate_landing", "datasets"), v("bronze", "rows"), v("silver", "valid"),
        v("silver", "quarantine"), v("gold", "tables"), v("warehouse", "fact_sales"), v("warehouse", "quality") or v("warehouse", "state") or SKIPPED, v("silver", "rate"), v("silver", "alert"), *cause,
    )
    VersionedTable(run.spark, joined_uri(run.root, "operations", "job_run_audit")).merge(run.spark.createDataFrame([row], RUN_SCHEMA), "orchestration_run_id")


def report(done: dict[str, Outcome]) -> str:
    return "\n".join(f"{o.task:<18}{o.state:<9}{o.seconds:8.2f} s  {o.failure or ''} {o.message or ''}".rstrip() for o in done.values())
