"""Bounded samples of labelled rows, drawn by hash so that every row has the same chance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from millrace.llm.common import small


def training_rows(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows that may be learned from: crc32 of the id as text, modulo 3, is not 1."""
    return df.where(F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 != 1, F.lit(True)))


def held_out(id_col: str = "doc_id"):
    """True where the row is kept from learning; a null id is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def hash_sample(df: DataFrame, label: str, each: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``each`` rows for each value of ``label``: those whose hash of the id and the other columns is least.

    Rows that are equal in all columns are one. A first pass counts the hashes of each label, within some per cent; a second
    keeps about four times what is wanted by a threshold on the hash, and one of equal rows, so that the final ranking
    sees a bounded number of rows whatever the size of the largest label. Rows of null or repeated ids have hashes of
    their own while anything else tells them apart.
    """
    others = sorted(c for c in df.columns if c not in (label, id_col))
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), *others, F.lit("sample")), F.lit(1 << 40))
    drawn = df.where(F.col(label).isNotNull()).withColumn("_draw", draw)
    counts = drawn.groupBy(label).agg(F.approx_count_distinct("_draw").alias("_n"))
    near = drawn.join(small(counts), label).where(F.col("_draw") <= F.lit(4.0 * each + 16) / F.col("_n") * (1 << 40)).dropDuplicates([label, "_draw"])
    rank = F.row_number().over(Window.partitionBy(label).orderBy("_draw", F.col(id_col).cast("string"), *others))
    return near.withColumn("_rank", rank).where(F.col("_rank") <= each).drop("_n", "_draw", "_rank")
