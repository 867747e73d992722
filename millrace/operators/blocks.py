"""Windows over groups of any size: hot groups are cut into blocks, and what blocks pass on is added afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.operators.keys import RANGE_ROWS, range_bounds, range_number

#: A side of at most this many narrow rows may be broadcast.
BROADCAST_ROWS = 1_000_000
#: Versions of one key up to which an as-of join may meet each of them.
FEW_VERSIONS = 32


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count shows at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores as it takes to be none of the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def blocked(df: DataFrame, group: list[str], by: Column, name: str, rows: int = RANGE_ROWS, counted: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """``df`` with the block of each row, ascending in ``by`` within its group, and whether any group has several.

    Groups of at most ``rows`` rows are block 0. Those with more, of which there are few, are cut at bounds drawn from all
    their rows, so that a block has some ``rows`` of them. Rows of equal ``by`` are in one block; NULL comes first.
    ``counted`` is what to count instead of ``df``, where that is cheaper: it has no fewer rows in any group.
    """
    value, hot = free(df, "_by", "_hot")
    large = (df if counted is None else counted).groupBy(*group).agg(F.count("*").alias("_n")).where(F.col("_n") > rows)
    n = large.agg(F.sum("_n")).first()[0]
    if not n:
        return df.withColumn(name, F.lit(0)), False
    marked = small(large.select(*(F.col(g).alias(f"_g{k}") for k, g in enumerate(group)), F.lit(True).alias(hot)))
    same = F.lit(True)
    for k, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{k}"))
    flagged = df.join(marked, same, "left").drop(*(f"_g{k}" for k in range(len(group)))).withColumn(value, by)
    bounds = range_bounds(flagged.where(F.col(hot)), value, n, n // rows + 1)
    block = F.when(F.coalesce(F.col(hot), F.lit(False)), range_number(F.col(value), bounds)).otherwise(F.lit(0))
    return flagged.withColumn(name, block).drop(value, hot), bool(bounds)


def running(df: DataFrame, group: list[str], by: str, then: list[str], number: str, totals: dict[str, str], previous: dict[str, str], rows: int = RANGE_ROWS, counted: DataFrame | None = None) -> DataFrame:
    """``df`` with the number of each row in its group, running sums, and values of the row before it.

    Rows are ordered by ``by`` and ``then``, NULLs first, which should leave no ties. ``totals`` and ``previous`` name the new
    columns and what they are made of. A blocked prefix scan: within blocks by a window; each block's rows, sums and last
    row are summed up once, and what the blocks before have is added. A group without a row gives none.
    """
    block, order, count, before = free(df, "_block", "_order", "_count", "_before")
    cut, several = blocked(df, group, F.col(by), block, rows, counted)
    w = Window.partitionBy(*group, block).orderBy(by, *then)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = cut.withColumns({number: F.row_number().over(w), **{n: F.sum(c).over(upto) for n, c in totals.items()}, **{n: F.lag(c).over(w) for n, c in previous.items()}})
    if not several:
        return found.drop(block)
    # one row for each block of a group: how many rows it has, their sums, its last row
    last = F.max_by(F.struct(*(F.col(c).alias(n) for n, c in previous.items())) if previous else F.lit(0), F.struct(by, *then))
    blocks = cut.groupBy(*group, block).agg(F.count("*").alias(count), last.alias(order), *(F.sum(c).alias(f"_sum_{n}") for n, c in totals.items()))
    b = Window.partitionBy(*group).orderBy(block)
    earlier = b.rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        *(F.col(g).alias(f"_g{k}") for k, g in enumerate(group)), F.col(block).alias("_b"), F.sum(count).over(earlier).alias(count),
        F.lag(order).over(b).alias(before), *(F.sum(f"_sum_{n}").over(earlier).alias(f"_sum_{n}") for n in totals),
    ).where(F.col("_b") > 0)
    same = F.col(block) == F.col("_b")
    for k, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{k}"))
    joined = found.join(small(offsets), same, "left")
    first = (F.col(number) == 1) & F.col("_b").isNotNull()
    values = {number: F.col(number) + F.coalesce(count, F.lit(0)).cast(found.schema[number].dataType)}
    for n in totals:
        add = F.col(f"_sum_{n}")
        values[n] = F.coalesce(F.col(n) + add, F.col(n), add).cast(found.schema[n].dataType)
    for n in previous:
        values[n] = F.when(first, F.col(before)[n]).otherwise(F.col(n))
    return joined.select(*df.columns, *(v.alias(n) for n, v in values.items()))


def dense_ranks(df: DataFrame, group: list[str], by: str, name: str, descending: bool = False, rows: int = RANGE_ROWS, counted: DataFrame | None = None) -> DataFrame:
    """``df`` with the dense rank of ``by`` within its group: ties share one, NULL is a value, the least (the last if ``descending``).

    Only distinct values are ranked: within the blocks of a hot group, whose numbers of values are the offsets of those that
    follow. So no task gets a whole hot group, and equal rows are one.
    """
    block, ordinal, count = free(df, "_block", "_ordinal", "_count")
    values = df.select(*group, by).distinct()
    cut, several = blocked(values, group, F.col(by), block, rows, counted)
    nulls = F.desc_nulls_last if descending else F.asc_nulls_first
    ranked = cut.withColumn(ordinal, F.dense_rank().over(Window.partitionBy(*group, block).orderBy(nulls(by))))
    if several:
        b = Window.partitionBy(*group).orderBy(F.desc(block) if descending else F.asc(block))
        sizes = cut.groupBy(*group, block).agg(F.count("*").alias("_n"))
        offsets = sizes.select(*(F.col(g).alias(f"_g{k}") for k, g in enumerate(group)), F.col(block).alias("_b"), F.sum("_n").over(b.rowsBetween(Window.unboundedPreceding, -1)).alias(count)).where(F.col(count).isNotNull())
        same = F.col(block) == F.col("_b")
        for k, g in enumerate(group):
            same = same & F.col(g).eqNullSafe(F.col(f"_g{k}"))
        ranked = ranked.join(small(offsets), same, "left").withColumn(ordinal, (F.col(ordinal) + F.coalesce(count, F.lit(0))).cast("int"))
    keys = [*group, by]
    found = ranked.select(*(F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)), F.col(ordinal).alias(name))
    same = F.lit(True)
    for n, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{n}"))
    return df.join(found, same).select(*df.columns, name)


def as_of(facts: DataFrame, versions: DataFrame, key: str, time: str, version_key: str, start: str, end: str, take: list[str], rows: int = RANGE_ROWS, few: int = FEW_VERSIONS) -> DataFrame:
    """``facts`` with the columns ``take`` of the version of their key that is valid at their time, NULL where there is none.

    A version is valid in [start, end), an end of NULL being open; the versions of a key must not overlap. Facts of null key
    or time have none. Where a count shows few versions, and few for each key, facts meet them in place. Otherwise both are one
    sequence, sorted once by key and time, along which the last version is carried forward: no row stands for a pair of
    fact and version. Hot keys are cut into blocks of time, each of which gets the last version of the blocks before.
    """
    v = versions.select(F.col(version_key).alias("_key"), F.col(start).alias("_from"), F.col(end).alias("_to"), *(F.col(c).alias(f"_take_{c}") for c in take)).where("_key is not null and _from is not null")
    each = v.groupBy("_key").agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
    if (each[0] or 0) <= few and (each[1] or 0) <= BROADCAST_ROWS:
        valid = (F.col(key) == F.col("_key")) & (F.col(time) >= F.col("_from")) & (F.col("_to").isNull() | (F.col(time) < F.col("_to")))
        return facts.join(F.broadcast(v), valid, "left").select(*facts.columns, *(F.col(f"_take_{c}").alias(c) for c in take))
    nowhere = facts.where(F.col(key).isNull() | F.col(time).isNull()).select(*facts.columns, *(F.lit(None).cast(versions.schema[c].dataType).alias(c) for c in take))
    facts = facts.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    version = F.struct("_to", *(f"_take_{c}" for c in take))
    both = (
        facts.select(F.col(key).alias("_key"), F.col(time).alias("_at"), F.lit(1).alias("_kind"), F.struct(*facts.columns).alias("_fact"))
        .unionByName(v.select("_key", F.col("_from").alias("_at"), F.lit(0).alias("_kind"), version.alias("_version")), allowMissingColumns=True)
    )
    cut, several = blocked(both, ["_key"], F.col("_at"), "_block", rows)
    # at one moment versions come before facts, and among them one that ends at once before one that lasts
    order = [F.col("_at"), F.col("_kind"), F.col("_version._to").asc_nulls_last()]
    w = Window.partitionBy("_key", "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = cut.withColumn("_last", F.last("_version", ignorenulls=True).over(w)).where("_kind = 1")
    if several:
        latest = cut.where("_kind = 0").groupBy("_key", "_block").agg(F.max_by("_version", F.struct("_at", F.col("_version._to").isNull(), "_version._to")).alias("_version"))
        grid = cut.where("_block > 0").select("_key", "_block").distinct().unionByName(latest.where("_block = 0").select("_key", "_block")).distinct()
        w = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        carried = grid.join(latest, ["_key", "_block"], "left").select(F.col("_key").alias("_k"), F.col("_block").alias("_b"), F.last("_version", ignorenulls=True).over(w).alias("_carried")).where("_b > 0")
        at = at.join(small(carried), F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_block") == F.col("_b")), "left").withColumn("_last", F.coalesce("_last", "_carried"))
    valid = F.col("_last._to").isNull() | (F.col("_at") < F.col("_last._to"))
    return at.select("_fact.*", *(F.when(valid, F.col(f"_last._take_{c}")).alias(c) for c in take)).unionByName(nowhere)
