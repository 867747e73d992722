"""Scans of delivered files and the plain Parquet sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.sources.schema import DATASETS, Dataset


def scan(spark: SparkSession, path: str, dataset: Dataset | str) -> DataFrame:
    """A dataset's files under its declared all-text schema: CSV with header, or JSON Lines."""
    d = DATASETS[dataset] if isinstance(dataset, str) else dataset
    reader = spark.read.schema(d.schema)
    return reader.json(path) if d.file_format == "json" else reader.options(header="true", mode="PERMISSIVE").csv(path)


def scan_as_text(spark: SparkSession, path: str | list[str], file_format: str) -> DataFrame:
    """A landed file, or several of the same columns, with their own columns, all text: nothing is inferred but the names."""
    if file_format == "json":
        return spark.read.option("primitivesAsString", "true").json(path)
    if file_format == "parquet":
        df = spark.read.parquet(*([path] if isinstance(path, str) else path))
        return df.select(*(df[c].cast("string").alias(c) for c in df.columns))
    return spark.read.options(header="true", inferSchema="false", mode="PERMISSIVE").csv(path)


def write(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Parquet in place of what is there, in folders by the given columns."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
