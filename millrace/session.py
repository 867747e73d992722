"""The one place that builds a session, and the folder that its machines share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "millrace", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew handling, ANSI left on. ``conf`` keys write dots as double underscores."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.sql.python.filterPushdown.enabled": "true",
        "spark.ui.enabled": "false",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }.items():
        b = b.config(key, value)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where none is named, a local master falls back on a folder of this machine; a cluster raises, as a local folder
    would lose data there without an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = f"file://{tempfile.gettempdir()}/checkpoints"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def reliable(df: DataFrame) -> DataFrame:
    """``df`` computed once, as a checkpoint in the shared folder: later uses agree, and a lost executor costs nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sql_over(spark: SparkSession, tables: dict[str, DataFrame], sql: str, args: dict | None = None) -> DataFrame:
    """``sql`` over DataFrames under names of its own; the session's views stay as they are. ``:name`` takes ``args``."""
    pattern = rf"\b(from|join)(\s+)({'|'.join(map(re.escape, tables))})\b"
    text = re.sub(pattern, r"\1\2{\3}", sql.replace("{", "{{").replace("}", "}}"), flags=re.I)
    used = {n: df for n, df in tables.items() if f"{{{n}}}" in text}
    return spark.sql(text, args=args or {}, **used) if used else spark.sql(sql, args=args or {})
