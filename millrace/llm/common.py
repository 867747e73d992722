"""What the text operators share: table access, shared folders, size-checked joins, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.session import reliable, shared_dir

#: A side with at most this many rows of a few fixed-width columns (some 32 MB) may be broadcast.
BROADCAST_ROWS = 1_000_000
#: Bytes of rows that a Python worker takes up at once, unless one row alone has more.
SLICE_BYTES = 16_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: ends the lineage in the shared folder, so a lost executor costs no recomputation."""
    return reliable(df)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as compressed Parquet in the shared folder, read back with their columns prunable."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path  # for discard()
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes what ``stored`` wrote, when nothing that is still to run reads it."""
    for df in frames:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count shows at most ``rows`` rows, else as it is (a shuffled join)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def keyed(docs: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """``docs`` and the name of a column of longs that tells all its rows apart, which stages that drop rows judge by.

    That is the id where none is null or repeated; else a number beside the other columns, given as the rows are
    written once to the shared folder. Those files stay, as the result is read from them.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("i"))
    if not ids.groupBy("i").count().where("i is null or count > 1").limit(1).count():
        return docs, id_col
    name = "_row"
    while name in (c.lower() for c in docs.columns):
        name += "_"
    return stored(docs.withColumn(name, F.monotonically_increasing_id()), "rows"), name


def without(docs: DataFrame, id_col: str, gone: DataFrame) -> DataFrame:
    """``docs`` less the rows whose id is in the one column of ``gone``; rows with a null id stay, columns as they were."""
    keys = gone.toDF(id_col)
    return docs.join(small(keys), id_col, "left_anti").select(*(docs[c] for c in docs.columns))


def modest(df: DataFrame, rows: int = 2000) -> DataFrame:
    """``df``, after its session was told to pass at most ``rows`` rows to Python at once: texts are large rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(key, "10000")) <= rows:
        conf.set(key, str(rows))
    return df


def bounded(batches: Iterator[pa.RecordBatch], rows: int = 1000, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows and, but for single rows, ``size`` bytes: what Python holds at once.

    At the end of a task, memory that numpy and Arrow have freed goes back to the system, as workers live on.
    """
    for b in batches:
        todo = [(at, min(rows, b.num_rows - at)) for at in range(0, b.num_rows, rows)][::-1]
        while todo:
            at, n = todo.pop()
            part = b.slice(at, n)
            if n > 1 and part.nbytes > size:
                todo += [(at + n // 2, n - n // 2), (at, n // 2)]
            else:
                yield part
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def strings(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column; null is empty."""
    return [x or "" for x in column.to_pylist()]


def utf8(text: str) -> bytes:
    """UTF-8 of a text; a lone surrogate, which Spark itself cannot hold, becomes '?'."""
    return text.encode("utf-8", "replace")


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, a bijection on 64-bit words."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges of longs, as rows (node, root), root the least node of each.

    Alternates large-star and small-star steps (Kiveris et al., 2014) written as aggregations and joins, so no
    neighbour list is ever gathered. Ends when a step changes nothing, after about log(n) ** 2 rounds at most; each round
    is checkpointed.
    """
    e = cut(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null and u <> v").distinct())
    sign = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        step = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = cut(step)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == sign:
            break
        sign = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
