"""Continuous ingestion of landed files: an extra, built on the same versioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.plans.layers import bronze_table
from millrace.sources.landing import joined_uri
from millrace.sources.schema import DATASETS


def landing_stream(spark: SparkSession, landing: str, dataset: str) -> DataFrame:
    """New files of a dataset as they land, with the lineage that the path tells."""
    d = DATASETS[dataset]
    path = joined_uri(landing, "retail", dataset, "*", "*")
    reader = spark.readStream.schema(d.schema)
    rows = reader.json(path) if d.file_format == "json" else reader.option("header", "true").csv(path)
    file = F.col("_metadata.file_path")
    return rows.select(
        "*",
        F.sha2(F.concat_ws("|", F.lit(dataset), F.lower(file), F.col("_metadata.file_modification_time").cast("string")), 256).alias("_ingestion_id"),
        F.col("_metadata.file_name").alias("_source_file"),
        file.alias("_source_path"),
        F.regexp_extract(file, "ingestion_date=([^/]+)", 1).alias("_ingestion_date"),
        F.regexp_extract(file, "run_id=([^/]+)", 1).alias("_adf_run_id"),
        F.current_timestamp().alias("_ingested_timestamp"),
    )


def ingest_available(spark: SparkSession, landing: str, root: str, dataset: str) -> StreamingQuery:
    """Appends what has landed since the last call, once, and ends. A batch that was committed before a crash is not added twice."""
    table = bronze_table(spark, root, dataset)

    def add(batch: DataFrame, number: int) -> None:
        if table.exists():
            batch = batch.join(table.read().select("_ingestion_id").distinct(), "_ingestion_id", "left_anti").select(*batch.columns)
        if not batch.isEmpty():
            table.append(batch)

    writer = landing_stream(spark, landing, dataset).writeStream.foreachBatch(add).option("checkpointLocation", joined_uri(root, "_checkpoints", dataset))
    return writer.trigger(availableNow=True).start()
