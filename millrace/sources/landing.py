"""The landing zone: path contract, discovery, content ids, and which files are still to be ingested."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from datetime import UTC, date, datetime
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.functions.secrets import redacted
from millrace.sources.schema import DATASETS

EXTENSIONS = {".csv": "csv", ".json": "json", ".jsonl": "json", ".parquet": "parquet"}
AUDIT_SCHEMA = "ingestion_id string, source_path string, dataset_name string, ingestion_date string, adf_run_id string, file_name string, file_sha256 string, status string, ingested_at timestamp"
SUCCESS = "SUCCESS"
_CONTRACT = re.compile(r"(?:^|/)retail/([^/]*)/ingestion_date=([^/]*)/run_id=([^/]*)/([^/]+)$")


class LandingPathError(ValueError):
    """A path that the contract does not allow."""


class LandingDiscoveryError(RuntimeError):
    """The landing zone could not be listed; the message holds no secrets."""


class LandingIncompleteError(RuntimeError):
    """A batch lacks datasets."""


def joined_uri(root: str, *parts: str) -> str:
    """Parts below a root, whose scheme stays as it is."""
    out = str(root).rstrip("/") if str(root) != "/" else ""
    return "/".join([out, *(p.strip("/") for p in parts if p.strip("/"))])


@dataclass(frozen=True)
class LandingFile:
    path: str
    dataset: str
    ingestion_date: str
    run_id: str
    file_name: str
    file_format: str
    sha256: str | None = None

    @property
    def ingestion_id(self) -> str:
        return ingestion_id(self.dataset, self.path, self.sha256)


def ingestion_id(dataset: str, path: str, sha256: str | None) -> str:
    """Content-based id; paths that differ in case only are the same."""
    return hashlib.sha256(f"{dataset.lower()}|{path.lower()}|{sha256 or ''}".encode()).hexdigest()


def parse_path(path: str, strict: bool = True) -> LandingFile:
    """…/retail/<dataset>/ingestion_date=<calendar date>/run_id=<id>/<file>; lenient paths get the stem, today and a local run."""
    name = PurePosixPath(path).name
    kind = EXTENSIONS.get(PurePosixPath(path).suffix.lower())
    m = _CONTRACT.search(path)
    if m:
        dataset, day, run, name = m.groups()
        try:
            ok = bool(re.fullmatch(r"\d{4}-\d{2}-\d{2}", day)) and bool(date.fromisoformat(day))
        except ValueError:
            ok = False
        if ok and dataset and run and kind:
            return LandingFile(path, dataset, day, run, name, kind)
    if strict:
        raise LandingPathError(f"not a landing path: {redacted(path)}")
    return LandingFile(path, PurePosixPath(path).stem, datetime.now(UTC).date().isoformat(), "local-batch", name, kind or "csv")


#: Bytes of a file that an executor may hold at once to hash it.
VALUE_BYTES = 256 << 20


def streamed_sha256(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file read as a stream, of which a few kilobytes are held at a time."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at)
    try:
        return jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


def discover(spark: SparkSession, root: str, datasets: list[str] | None = None, strict: bool = True) -> list[LandingFile]:
    """Files below ``root`` in order of path, with SHA-256 of their bytes; hidden names (``.x``, ``_x``) are passed over.

    Listing and hashing are Spark's (the binaryFile source), so any scheme it reads will do, and hashing is spread
    over the executors; only one row per file comes back. Files of over ``VALUE_BYTES`` are hashed as streams.
    """
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(root))
        # the scan looks at no content of files beyond the limit, which a binary value could not hold
        rows = [tuple(r) for r in files.where(F.col("length") <= VALUE_BYTES).select("path", F.sha2("content", 256)).collect()]
        rows += [(r["path"], streamed_sha256(spark, r["path"])) for r in files.where(F.col("length") > VALUE_BYTES).select("path").collect()]
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return []
        raise LandingDiscoveryError(redacted(f"{root}: {e}")[:2000]) from None
    out = []
    for path, sha in sorted(rows):
        path = re.sub(r"^file:/+", "/", path)
        if PurePosixPath(path).name.startswith((".", "_")):
            continue
        f = parse_path(path, strict or ("://" in str(root) and not str(root).startswith("file:")))
        if datasets is None or f.dataset in datasets:
            out.append(LandingFile(f.path, f.dataset, f.ingestion_date, f.run_id, f.file_name, f.file_format, sha))
    return out


def manifest(spark: SparkSession, files: list[LandingFile]) -> DataFrame:
    """One row per file."""
    return spark.createDataFrame(
        [(f.ingestion_id, f.path, f.dataset, f.ingestion_date, f.run_id, f.file_name, f.file_format, f.sha256) for f in files],
        "ingestion_id string, source_path string, dataset_name string, ingestion_date string, adf_run_id string, file_name string, file_format string, file_sha256 string",
    )


def pending(files: DataFrame, audit: DataFrame) -> DataFrame:
    """Files of the manifest whose path and id both have no successful entry in the audit."""
    done = audit.where(F.col("status") == SUCCESS)
    by_id = files.join(done.select(F.col("ingestion_id").alias("_id")), F.col("ingestion_id") == F.col("_id"), "left_anti")
    return by_id.join(done.select(F.col("source_path").alias("_path")), F.col("source_path") == F.col("_path"), "left_anti")


def batch(files: DataFrame, ingestion_date: str | None = None, run_id: str | None = None) -> DataFrame:
    """Files of one date and run, or of any where not given."""
    if ingestion_date:
        files = files.where(F.col("ingestion_date") == ingestion_date)
    return files.where(F.col("adf_run_id") == run_id) if run_id else files


def assert_complete(files: list[LandingFile], ingestion_date: str, run_id: str | None = None, wanted: tuple[str, ...] = tuple(DATASETS)) -> list[str]:
    """Datasets of the batch; raises if any is missing."""
    there = {f.dataset for f in files if f.ingestion_date == ingestion_date and (run_id is None or f.run_id == run_id)}
    if missing := [d for d in wanted if d not in there]:
        raise LandingIncompleteError(f"batch {ingestion_date}/{run_id or '*'} lacks {missing}")
    return sorted(there)


def drop_file(spark: SparkSession, source: str, root: str, dataset: str, ingestion_date: str, run_id: str) -> str:
    """Copies a delivered file to its place in the landing zone and returns that path."""
    target = joined_uri(root, "retail", dataset, f"ingestion_date={ingestion_date}", f"run_id={run_id}", PurePosixPath(source).name)
    parse_path(target)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, True, conf)
    return target
