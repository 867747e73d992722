"""What the files of a table may hold: key ranges and Bloom filters, so that a merge opens only files that matter.

An index is a key column and, perhaps, a condition: of ``customer_id where is_current`` only rows that are current
count. Its rows are (file, rows, lo, hi, width, bucket, bits): the number of such rows in a file, their least and greatest
key, and a Bloom filter of 2 ** width bits in pieces of 32 768. They are written as Parquet beside the log, which names
them; nothing of them but names of files comes to the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

#: Bits a key, and positions that each key sets: one key in some 8000 seems to be where it is not.
BITS_PER_KEY, POSITIONS = 24, 6
#: Bits of a piece, as a power of two (what ``bitmap_construct_agg`` makes), and of the largest filter.
PIECE, WIDEST = 15, 30
#: Ranges that the keys looked for are summed up in.
RANGES = 512
#: Filters are built where a look-up of the keys takes at most this part of the rows that they are built from.
BUILT_FOR = 8


@dataclass(frozen=True)
class Index:
    key: str
    where: str | None = None

    @property
    def name(self) -> str:
        return self.key if self.where is None else f"{self.key} where {self.where}"

    @classmethod
    def named(cls, name: str) -> Index:
        key, _, where = name.partition(" where ")
        return cls(key, where or None)


def indexable(schema: StructType, key: str) -> bool:
    """Floating-point keys are not: values that are equal there can differ in their bits."""
    return key in schema.names and not isinstance(schema[key].dataType, (FloatType, DoubleType)) and "<" not in schema[key].dataType.simpleString()


#: The bits of a ``key`` in a filter of 2 ** ``width`` bits.
AT = f"transform(array({', '.join(map(str, range(POSITIONS)))}), k -> pmod(xxhash64(key, k), shiftleft(1L, width)))"


def spans(rows: DataFrame, index: Index, local: Callable[[Column], Column]) -> DataFrame:
    """(file, rows, lo, hi) of ``rows``, read from files, in one pass over the key; ``local`` makes a table's name of a file from its path."""
    kept = rows.where(index.where) if index.where else rows
    keys = kept.select(local(F.col("_metadata.file_path")).alias("file"), F.col(index.key).alias("key"))
    return keys.groupBy("file").agg(F.count("key").alias("rows"), F.min("key").alias("lo"), F.max("key").alias("hi"))


def describe(rows: DataFrame, index: Index, local: Callable[[Column], Column]) -> DataFrame:
    """The index rows of ``rows``, read from files."""
    kept = rows.where(index.where) if index.where else rows
    keys = kept.select(local(F.col("_metadata.file_path")).alias("file"), F.col(index.key).alias("key"))
    sizes = spans(rows, index, local)
    sizes = sizes.withColumn("width", F.least(F.greatest(F.ceil(F.log2(F.col("rows") * BITS_PER_KEY + 1)), F.lit(PIECE)), F.lit(WIDEST)).cast("int"))
    bits = keys.where("key is not null").distinct().join(sizes.select("file", "width"), "file").select("file", F.explode(F.expr(AT)).alias("at"))
    pieces = bits.groupBy("file", F.shiftright("at", PIECE).alias("bucket")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND((1 << PIECE) - 1)).alias("bits"))
    return sizes.join(pieces, "file", "left")


def ranged(keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(key, range) of the keys looked for, and (range, least, most, n), at most RANGES rows."""
    # a hash that keeps no order would do as well for even ranges; ranges by value tell files apart
    wanted = keys.select(F.col(key).alias("key")).where("key is not null")
    bounds = [r[0] for r in wanted.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < share(wanted)).select("key").distinct().sort("key").collect()]
    step = max(1, len(bounds) // RANGES)
    cuts = bounds[step::step][: RANGES - 1]
    number = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda b: b <= F.col("key"))) if cuts else F.lit(0)
    numbered = wanted.withColumn("range", number)
    return numbered, numbered.groupBy("range").agg(F.min("key").alias("least"), F.max("key").alias("most"), F.count("*").alias("n"))


def overlapping(files: DataFrame, ranges: DataFrame) -> DataFrame:
    """A row of a file and a range for each two that overlap."""
    return files.join(F.broadcast(ranges), (F.col("lo") <= F.col("most")) & (F.col("hi") >= F.col("least")))


def within_spans(files: DataFrame, keys: DataFrame, key: str) -> tuple[list[str], bool]:
    """Files (rows of ``spans``) whose span overlaps the keys, and whether the keys are so few that filters should tell more.

    Building filters takes several passes over the keys of all files, and they tell nothing where every file has keys of
    its own among those looked for; then the key columns are read as they are.
    """
    pairs = overlapping(files, ranged(keys, key)[1]).select("file", "n").collect()  # at most RANGES rows for a file
    rows = files.agg(F.sum("rows")).first()[0] or 0
    tests = sum(r["n"] for r in pairs)
    return sorted({r["file"] for r in pairs}), 0 < tests * POSITIONS * BUILT_FOR <= rows


def holders(index_rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """(file): files of the index that may hold one of ``keys``; all that do, and few others.

    The keys are summed up in ranges, so that a file meets each range once and the keys only in ranges that overlap its own.
    Keys are then looked up in the filters of those files, unless that is more work than to read their keys.
    """
    files = index_rows.select("file", "rows", "lo", "hi", "width").distinct()
    numbered, ranges = ranged(keys, key)
    pairs = overlapping(files, ranges)
    tests = pairs.agg(F.sum("n")).first()[0]
    if not tests:
        return files.select("file").where("false")
    if tests * POSITIONS > 4 * files.agg(F.sum("rows")).first()[0]:
        return pairs.select("file").distinct()
    inside = (F.col("key") >= F.col("lo")) & (F.col("key") <= F.col("hi"))
    asked = pairs.select("file", "range", "lo", "hi", "width").join(numbered, "range").where(inside).select("file", "key", F.explode(F.expr(AT)).alias("at"))
    asked = asked.select("file", "key", F.shiftright("at", PIECE).alias("bucket"), F.col("at").bitwiseAND((1 << PIECE) - 1).alias("bit"))
    byte = F.conv(F.hex(F.substring("bits", (F.shiftright("bit", 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.expr("shiftright(_byte, cast(bit & 7 as int)) & 1") == 1
    found = asked.join(index_rows.select("file", "bucket", "bits"), ["file", "bucket"], "left").withColumn("_byte", byte).groupBy("file", "key").agg(F.min(F.coalesce(hit, F.lit(False))).alias("all"))
    return found.where("all").select("file").distinct()


def share(keys: DataFrame) -> float:
    """The threshold of a hash, of 2 ** 20, that draws some ``RANGES`` * 16 of the keys."""
    return min(1.0, RANGES * 16 / max(1, keys.count())) * (1 << 20)
