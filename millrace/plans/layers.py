"""Bronze, Silver and Gold over versioned tables, idempotent and safe to run again after a crash."""

from __future__ import annotations

import contextlib
import re
from datetime import UTC, datetime
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.operators.conform import REDELIVERED, Conformed, ReconciliationError, conform
from millrace.operators.incremental import KEPT
from millrace.operators.kpi import KPI
from millrace.operators.rules import ORDER, SILVER
from millrace.sources.files import scan_as_text
from millrace.sources.landing import AUDIT_SCHEMA, SUCCESS, LandingFile, joined_uri, manifest, pending
from millrace.sources.schema import DATASETS
from millrace.sources.versioned import TableNotFoundError, VersionedTable


def bronze_table(spark: SparkSession, root: str, dataset: str) -> VersionedTable:
    return VersionedTable(spark, joined_uri(root, "bronze", dataset))


def audit_table(spark: SparkSession, root: str) -> VersionedTable:
    return VersionedTable(spark, joined_uri(root, "operations", "ingestion_audit"))


def load(spark: SparkSession, root: str, layer: str, name: str) -> DataFrame:
    table = VersionedTable(spark, joined_uri(root, layer, name))
    if not table.exists():
        raise TableNotFoundError(table.path)
    return table.read()


def merge_silver(spark: SparkSession, root: str, name: str, rows: DataFrame) -> int:
    """Upserts conformed rows into a Silver table on the dataset's key; every matched row takes what is delivered."""
    return VersionedTable(spark, joined_uri(root, "silver", name)).merge(rows, SILVER[name].key)


def merge_customers(spark: SparkSession, root: str, rows: DataFrame) -> int:
    return merge_silver(spark, root, "customers", rows)


def merge_products(spark: SparkSession, root: str, rows: DataFrame) -> int:
    return merge_silver(spark, root, "products", rows)


def merge_orders(spark: SparkSession, root: str, rows: DataFrame) -> int:
    return merge_silver(spark, root, "orders", rows)


def with_lineage(df: DataFrame, files: DataFrame, at: datetime) -> DataFrame:
    """Rows of a scan with where each came from, by the path of its file in the manifest.

    How the scan writes the path is worked out once for each file, so that rows are only looked up.
    """
    lineage = files.select(F.col("source_path").alias("_source_path"), F.col("ingestion_id").alias("_ingestion_id"), F.col("file_name").alias("_source_file"), F.col("ingestion_date").alias("_ingestion_date"), F.col("adf_run_id").alias("_adf_run_id"))
    cols = [c for c in df.columns]
    # the scan and the manifest both have one short row for each file of this call
    uris = {form for uri in df.inputFiles() for form in (uri, re.sub("^file:/+", "file:/", uri))}  # of local files rows have the second form
    read = df.sparkSession.createDataFrame([(uri, re.sub("^file:/+", "/", unquote(uri))) for uri in sorted(uris)], "_path string, _plain string")
    lineage = read.join(lineage, F.col("_plain") == F.regexp_replace("_source_path", "^file:/+", "/")).drop("_plain")
    out = df.withColumn("_path", F.col("_metadata.file_path")).join(F.broadcast(lineage), "_path")
    return out.select(*cols, "_ingestion_id", "_source_file", "_source_path", "_ingestion_date", "_adf_run_id", F.lit(at).cast("timestamp").alias("_ingested_timestamp"))


def scanned(spark: SparkSession, dataset: str, files: list[LandingFile], at: datetime) -> DataFrame:
    """All rows of the files: one scan for those of the same format and columns, whatever their number."""
    groups: dict[tuple, list[LandingFile]] = {}
    for f in files:
        columns = () if f.file_format == "json" else tuple(scan_as_text(spark, f.path, f.file_format).columns)
        groups.setdefault((f.file_format, columns), []).append(f)
    parts = []
    for (file_format, _), mine in groups.items():
        df = scan_as_text(spark, [f.path for f in mine], file_format)
        parts.append(_declared(with_lineage(df, manifest(spark, mine), at), dataset))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _declared(df: DataFrame, dataset: str) -> DataFrame:
    """The dataset's columns as text, those that a file lacks NULL; further columns stay behind them."""
    d = DATASETS.get(dataset)
    if not d:
        return df
    have = set(df.columns)
    return df.select(*(F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in d.columns), *(c for c in df.columns if c not in d.columns))


def ingest_bronze(spark: SparkSession, root: str, files: list[LandingFile], force: bool = False, at: datetime | None = None) -> dict[str, int]:
    """Appends files that the audit does not have; returns rows newly appended by dataset.

    The data commit comes before the audit's: ids that a table already holds are not appended again but audited, so
    a crash between the two loses and doubles nothing. One commit per dataset, whatever the number of files.
    """
    at = at or datetime.now(UTC)
    audit = audit_table(spark, root)
    done_ids, done_paths = set(), set()
    if audit.exists() and not force:
        wanted = manifest(spark, files)
        for r in wanted.join(pending(wanted, audit.read()), "ingestion_id", "left_anti").collect():  # at most one row per landed file of this call
            done_ids.add(r["ingestion_id"])
            done_paths.add(r["source_path"])
    todo = [f for f in files if f.ingestion_id not in done_ids and f.path not in done_paths]
    added: dict[str, int] = {}
    for dataset in sorted({f.dataset for f in todo}):
        mine = [f for f in todo if f.dataset == dataset]
        table = bronze_table(spark, root, dataset)
        present: set[str] = set()
        if table.exists():
            wanted = F.broadcast(manifest(spark, mine).select(F.col("ingestion_id").alias("_ingestion_id")))
            held = table.read().select("_ingestion_id").join(wanted, "_ingestion_id", "left_semi").distinct()
            present = {r[0] for r in held.collect()}
        fresh = [f for f in mine if f.ingestion_id not in present]
        added[dataset] = 0
        if fresh:
            version = table.append(scanned(spark, dataset, fresh, at), merge_schema=True)
            added[dataset] = table.entry(version)["rows_added"]
    if todo:
        rows = [(f.ingestion_id, f.path, f.dataset, f.ingestion_date, f.run_id, f.file_name, f.sha256, SUCCESS, at) for f in todo]
        audit.merge(spark.createDataFrame(rows, AUDIT_SCHEMA).dropDuplicates(["ingestion_id"]), "ingestion_id")
    return added


def silver_frames(bronze: dict[str, DataFrame]) -> dict[str, Conformed]:
    """All datasets conformed in the order of their references."""
    out: dict[str, Conformed] = {}
    for name in ORDER:
        spec = SILVER[name]
        out[name] = conform(bronze[name], spec, {p.parent: out[p.parent].valid for p in spec.parents})
    return out


def build_silver(spark: SparkSession, root: str, supersede: bool = False, names: tuple[str, ...] = ORDER) -> dict[str, dict[str, int]]:
    """Full refresh of valid and quarantined rows of the datasets (parents before children); each must add up to its source.

    One execution for each output and none for counts: reasons are counted while the valid rows are written, the commits
    count what was written, and the log of Bronze says what came in. Parents are read back from what was just written.
    With ``supersede`` rows that a later delivery repeats are told apart (``redelivered``, within ``quarantine``), so that
    delivering a whole table again leaves the rate of rejected rows as it was.
    """
    counts: dict[str, dict[str, int]] = {}
    valid: dict[str, DataFrame] = {}
    for name in names:
        spec = SILVER[name]
        bronze = bronze_table(spark, root, name)
        if not bronze.exists():
            raise TableNotFoundError(bronze.path)
        at = bronze.latest()
        both = conform(bronze.read(at), spec, {p.parent: valid[p.parent] for p in spec.parents}, supersede)
        good = VersionedTable(spark, joined_uri(root, "silver", name))
        bad = VersionedTable(spark, joined_uri(root, "silver", f"{name}_quarantine"))
        rows, counted = both.observed()
        n = {"valid": good.entry(good.overwrite(rows))["rows_added"], "quarantine": bad.entry(bad.overwrite(both.rejected))["rows_added"], "bronze": bronze.rows(at)}
        reasons = counted()
        n["redelivered"] = reasons.get(REDELIVERED, 0)
        assert_adds_up(name, n["bronze"], n["valid"], n["quarantine"])
        assert_adds_up(name, n["bronze"], reasons.get(None, 0), sum(v for k, v in reasons.items() if k))
        counts[name] = n
        valid[name] = good.read()
    return counts


def assert_adds_up(name: str, source: int, valid: int, rejected: int) -> None:
    if source != valid + rejected:
        raise ReconciliationError(f"{name}: {source} source rows, {valid} valid and {rejected} quarantined")


def _silver_tables(spark: SparkSession, root: str) -> dict[str, VersionedTable]:
    return {n: VersionedTable(spark, joined_uri(root, "silver", n)) for n in ("customers", "products", "stores", "orders", "order_items", "returns")}


def build_kpi(gold: VersionedTable, name: str, silver: dict[str, VersionedTable]) -> int:
    """A KPI table built whole; its rows. The entry notes which version of each Silver table it shows."""
    at = {n: silver[n].latest() for n in KEPT[name].uses}
    rows = KPI[name]({n: silver[n].read(v) for n, v in at.items()})
    return gold.entry(gold.overwrite(rows, notes={"sources": at}))["rows_added"]


def refresh_kpi(gold: VersionedTable, name: str, silver: dict[str, VersionedTable]) -> int | None:
    """Brings a KPI table up to the newest versions of its Silver tables; how many of its keys were computed anew.

    What changed since the versions that it shows names these keys; their rows are replaced in one commit, which notes the new
    versions, so a refresh that is cut off changes nothing and the next makes up for it. A table that is not there, shows
    versions that are not there any more, or has other columns by now is built whole, and None returned.
    """
    kept, build = KEPT[name], KPI[name]
    at = {n: silver[n].latest() for n in kept.uses}
    now = {n: silver[n].read(v) for n, v in at.items()}
    base = gold.latest() if gold.exists() else -1
    shown = gold.entry(base).get("notes", {}).get("sources", {}) if base >= 0 else {}
    known = set(shown) == set(at) and all(v in silver[n].versions() and v <= at[n] for n, v in shown.items())
    if not known or gold.schema(base).names != build(now).columns:
        build_kpi(gold, name, silver)
        return None
    if shown == at:
        return 0
    with contextlib.ExitStack() as stack:
        # changes are read several times, so they are written once; the size of what was written tells which joins may broadcast
        changed = {n: silver[n].changes(shown[n], at[n], columns) for n, columns in kept.uses.items()}
        changed = {n: stack.enter_context(gold.once(df)) if shown[n] != at[n] else df for n, df in changed.items()}
        keys = kept.touched(now, changed).select(*kept.key)
        return gold.exchange(keys, lambda wanted: build(kept.only(now, wanted)), "REFRESH", base, {"sources": at})


def build_gold(spark: SparkSession, root: str) -> dict[str, int]:
    """The six KPI tables from Silver; returns their rows."""
    silver = _silver_tables(spark, root)
    return {name: build_kpi(VersionedTable(spark, joined_uri(root, "gold", name)), name, silver) for name in KPI}


def refresh_gold(spark: SparkSession, root: str) -> dict[str, int | None]:
    """The six KPI tables brought up to Silver; returns how many keys of each were computed anew, None for one built whole."""
    silver = _silver_tables(spark, root)
    return {name: refresh_kpi(VersionedTable(spark, joined_uri(root, "gold", name)), name, silver) for name in KPI}
