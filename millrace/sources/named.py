"""Versioned tables as a data source, ``spark.read.format("millrace")``, and by names of the session's catalog.

Options: ``path``; ``version`` or ``as_of`` (the newest version if neither is given); ``columns``, names joined by commas;
``filters``, true or false. The files of one version are fixed when a query is planned, so later commits do not disturb it;
each is a partition of its own, read as Arrow batches. With ``filters``, comparisons of whole numbers, texts, dates and booleans
with constants, IN lists and null tests reach the Parquet readers, which skip row groups by them; Spark looks at every filter
once more. It needs ``spark.sql.python.filterPushdown.enabled``, which ``session`` sets: where that is off, Spark rejects a
source that takes filters. This interface hands no column list to a source: without ``columns`` all are read.
``VersionedTable.read`` has Spark's own scan, which prunes them.

A package named ``pyspark_millrace`` makes every session find the source by itself where it is on the Python path.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import datasource as api
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, DateType, IntegralType, StringType, StructType

from millrace.sources.tablelog import SchemaMismatchError, TableLog, TableNotFoundError

#: What constants a column of a type may be compared with before Spark does.
COMPARED = ((BooleanType, bool), (IntegralType, int), (StringType, str), (DateType, datetime.date))
BATCH_ROWS = 10_000


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """Where a path is, and its name there; local paths may have a scheme or none."""
    local = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(path)


class ArrowLog(TableLog):
    """The log read without a session, as planning in a Python worker needs it."""

    def __init__(self, path: str):
        self._fs, local = filesystem(path)
        super().__init__(local)

    def _names(self) -> list[str]:
        return [i.base_name for i in self._fs.get_file_info(fs.FileSelector(f"{self.path}/_log", allow_not_found=True))]

    def _load(self, path: str) -> str:
        try:
            with self._fs.open_input_stream(path) as f:
                return f.read().decode()
        except FileNotFoundError as e:
            raise TableNotFoundError(path) from e


def expression(f: api.Filter, schema: StructType) -> tuple[str, ds.Expression] | None:
    """The column that a filter looks at and the filter itself, None for one that is left to Spark."""
    if isinstance(f, api.Not):
        inner = expression(f.child, schema)
        return (inner[0], ~inner[1]) if inner else None
    name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
    if name not in schema.names:
        return None
    col = ds.field(name)
    if isinstance(f, (api.IsNull, api.IsNotNull)):
        return name, col.is_null() if isinstance(f, api.IsNull) else col.is_valid()
    values = list(f.value) if isinstance(f, api.In) else [getattr(f, "value", None)]
    kind = next((k for t, k in COMPARED if isinstance(schema[name].dataType, t)), None)
    if kind is None or not all(type(v) is kind for v in values):
        return None
    if isinstance(f, api.In):
        return name, col.isin(values)
    v = values[0]
    for cls, made in ((api.EqualTo, col == v), (api.GreaterThan, col > v), (api.GreaterThanOrEqual, col >= v), (api.LessThan, col < v), (api.LessThanOrEqual, col <= v)):
        if isinstance(f, cls):
            return name, made
    return None


class Reader(api.DataSourceReader):
    def __init__(self, path: str, files: list[str], schema: StructType):
        self.path, self.files, self.schema, self.filters = path, files, schema, []

    def partitions(self) -> list[api.InputPartition]:
        return [api.InputPartition(f) for f in self.files]

    def read(self, partition: api.InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is None or partition.value is None:  # a version without files
            return
        where, root = filesystem(self.path)
        target = to_arrow_schema(self.schema)
        files = ds.ParquetFileFormat(read_options={"coerce_int96_timestamp_unit": "us"})
        fragment = files.make_fragment(f"{root.rstrip('/')}/{partition.value}", where)
        there = fragment.physical_schema.names
        pushed = None
        for name, e in filter(None, (expression(f, self.schema) for f in self.filters)):
            if name in there:
                pushed = e if pushed is None else pushed & e
        columns = [n for n in target.names if n in there]
        for batch in fragment.to_batches(columns=columns, filter=pushed, batch_size=BATCH_ROWS):
            # a column that the file lacks is NULL
            arrays = [batch.column(f.name).cast(f.type, safe=False) if f.name in columns else pa.nulls(batch.num_rows, f.type) for f in target]
            yield pa.RecordBatch.from_arrays(arrays, schema=target)


class FilteringReader(Reader):
    def pushFilters(self, filters: list[api.Filter]) -> Iterable[api.Filter]:
        self.filters = list(filters)
        return self.filters


class Millrace(api.DataSource):
    @classmethod
    def name(cls) -> str:
        return "millrace"

    def _entry(self) -> dict:
        path = self.options.get("path")
        if not path:
            raise ValueError("the option path is missing")
        log, version = ArrowLog(path), self.options.get("version")
        return log.entry(log.resolve(None if version is None else int(version), self.options.get("as_of")))

    def schema(self) -> StructType:
        known = StructType.fromJson(self._entry()["schema"])
        asked = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        missing = [c for c in asked if c not in known.names]
        if missing:
            raise SchemaMismatchError(f"no columns {missing}")
        return StructType([known[c] for c in asked]) if asked else known

    def reader(self, schema: StructType) -> Reader:
        kind = FilteringReader if self.options.get("filters", "false").lower() == "true" else Reader
        return kind(self.options["path"], self._entry()["live"] or [None], schema)


def enable(spark: SparkSession) -> None:
    """Makes the source known to a session that does not find it by itself."""
    try:
        spark.dataSource.register(Millrace)
    except AnalysisException as e:
        if e.getCondition() != "DATA_SOURCE_ALREADY_EXISTS":
            raise


def quoted(name: str) -> str:
    return ".".join(f"`{part.replace('`', '``')}`" for part in name.split("."))


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: What follows the name of a table in that of the one with its columns.
COLUMNS = "__columns"


def create_table(spark: SparkSession, name: str, path: str, version: int | None = None, filters: bool = False) -> None:
    """A name in the session's catalog for the versioned table at ``path``: its newest version, or always the one given.

    Spark does not hand the options of a catalog's table to a source of this kind when it reads, only those of a query. So
    ``<name>__columns`` is a table ``USING millrace``, which has the columns, and ``name`` a view of it that gives the options. It
    has the columns of now; created again, it has those of a later version. ``filters`` as above, for all who will read it.
    """
    enable(spark)
    drop_table(spark, name)
    options = {"path": str(path), "filters": str(filters).lower()} | ({} if version is None else {"version": str(int(version))})
    listed = ", ".join(f"{literal(k)} = {literal(v)}" for k, v in options.items())
    spark.sql(f"CREATE TABLE {quoted(name + COLUMNS)} USING millrace OPTIONS ({listed})")
    spark.sql(f"CREATE VIEW {quoted(name)} AS SELECT * FROM {quoted(name + COLUMNS)} WITH ({listed})")


def drop_table(spark: SparkSession, name: str) -> None:
    """Takes the name away; the files stay."""
    spark.sql(f"DROP VIEW IF EXISTS {quoted(name)}")
    spark.sql(f"DROP TABLE IF EXISTS {quoted(name + COLUMNS)}")
