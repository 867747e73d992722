"""Dense surrogate keys without a single-task window."""

from __future__ import annotations

from itertools import accumulate
from math import isqrt

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Rows that a range holds on average, and rows drawn for each bound between two ranges.
RANGE_ROWS, DRAWN = 200_000, 20
_DRAW = 1 << 40


def range_bounds(keys: DataFrame, by: str, rows: int, parts: int) -> list:
    """At most ``parts`` - 1 ascending values that cut ``rows`` rows into ranges of about the same size.

    They come from rows drawn by a hash of the value, some ``DRAWN`` for each range, so that many values reach the
    driver whatever the number of rows. Any bounds give right numbers; even ones give even tasks.
    """
    if parts < 2:
        return []
    share = F.lit(_DRAW * min(1.0, DRAWN * parts / rows))
    drawn = sorted(r[0] for r in keys.where(F.col(by).isNotNull() & (F.pmod(F.xxhash64(by), F.lit(_DRAW)) < share)).select(by).distinct().collect())
    return sorted({drawn[k * len(drawn) // parts] for k in range(1, parts)}) if drawn else []


def range_number(by: Column, bounds: list) -> Column:
    """How many bounds are not above ``by``: a plain function of the value, so that all uses agree. NULL is in range 0.

    Bounds stand in groups; the first of each group tells which group is looked at, so few are compared.
    """
    if not bounds:
        return F.lit(0)
    each = isqrt(len(bounds) - 1) + 1
    groups = [bounds[k : k + each] for k in range(0, len(bounds), each)]

    def passed(values: Column) -> Column:
        return F.size(F.filter(values, lambda b: b <= by))

    group = passed(F.array(*(F.lit(g[0]) for g in groups)))
    inside = F.get(F.array(*(F.array(*map(F.lit, g)) for g in groups)), group - 1)
    return F.when(group > 0, (group - 1) * each + passed(inside)).otherwise(0)


def dense_numbers(df: DataFrame, by: str, name: str, start: int = 1, range_rows: int = RANGE_ROWS, rows: int | None = None, then: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``name`` = start, start + 1, ... in the order of ``by``, as a global row_number would give.

    Rows are numbered within ranges of ``by``, and the sizes of the ranges, one row each, give each its offset. The
    bounds are chosen once, before either is computed. ``by``, and ``then`` within it, must be unique for the numbers to be
    determined; NULL comes first. An empty ``df`` gives no rows. ``rows`` is the number of rows, where it is known already.
    """
    rows = df.count() if rows is None else rows
    bounds = range_bounds(df, by, rows, rows // range_rows + 1)
    ranged = df.withColumn("_part", range_number(F.col(by), bounds))
    within = ranged.withColumn("_nth", F.row_number().over(Window.partitionBy("_part").orderBy(*(F.col(c).asc_nulls_first() for c in (by, *then)))))
    number = F.col("_nth")
    if bounds:
        # one row for each range
        sizes = {r["_part"]: r["count"] for r in ranged.groupBy("_part").count().collect()}
        offsets = [0, *accumulate(sizes.get(k, 0) for k in range(len(bounds)))]
        number = number + F.get(F.array(*map(F.lit, offsets)), F.col("_part"))
    return within.withColumn(name, (number + (start - 1)).cast("int")).drop("_part", "_nth")


def surrogate_keys(existing: DataFrame | None, incoming: DataFrame, natural: str, surrogate: str) -> DataFrame:
    """Distinct ``incoming`` natural keys with their surrogate: known ones keep theirs, new ones follow the maximum."""
    wanted = incoming.select(natural).where(F.col(natural).isNotNull()).distinct()
    if existing is None:
        return dense_numbers(wanted, natural, surrogate).select(natural, surrogate)
    known = existing.select(natural, surrogate)
    top = known.agg(F.max(surrogate)).first()[0] or 0
    kept = wanted.join(known, natural)
    fresh = dense_numbers(wanted.join(known, natural, "left_anti"), natural, surrogate, top + 1)
    return kept.select(natural, F.col(surrogate).cast("int").alias(surrogate)).unionByName(fresh.select(natural, surrogate))
