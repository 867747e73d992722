"""Global ranking against a plain count in Python."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm.ranking import line_places, ranked

NAMES = ("pos", "place", "dense", "tied")


def brute(rows, group, by, then):
    """(row, pos, place, dense, tied) of each row; ``by`` and ``then`` give sort keys."""
    groups = defaultdict(list)
    for r in rows:
        groups[group(r)].append(r)
    out = []
    for members in groups.values():
        members.sort(key=lambda r: (by(r), then(r)))
        pairs = [by(r) for r in members]
        count, order = Counter(pairs), sorted(set(pairs))
        for k, r in enumerate(members):
            out.append((r, k + 1, pairs.index(pairs[k]) + 1, order.index(pairs[k]) + 1, count[pairs[k]]))
    return out


def some(n, seed, hot):
    rng = random.Random(seed)
    return [(None if rng.random() < 0.05 else 1 if rng.random() < hot else rng.randrange(6), rng.choice([None, float("nan"), 0.5, 1.5, 2.5]), rng.choice(["a", "b", None]), rng.randrange(4)) for _ in range(n)]


def first(v, of=lambda v: v):
    return (0, 0) if v is None else (1, of(v))


@pytest.mark.parametrize(("n", "parts", "hot"), [(0, 4, 0), (1, 4, 0), (400, 1, 0.3), (400, 7, 0.9), (700, 40, 0.6)])
def test_ranked(spark, n, parts, hot):
    rows = some(n, n + parts, hot)
    df = spark.createDataFrame(rows, "g long, x double, y string, z int").withColumn("part", F.lit("kept"))
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        by = {"x": F.asc_nulls_first("x"), "y": F.asc_nulls_first("y")}
        got = ranked(df, ["g"], by, {"z": F.asc("z")})
        assert got.columns == ["g", "x", "y", "z", "part", *NAMES]
        plain = lambda v: "nan" if v != v else v
        want = brute(rows, lambda r: r[0], lambda r: (first(r[1], lambda v: float("inf") if v != v else v), first(r[2])), lambda r: r[3])
        want = Counter((*map(plain, r), *x) for r, *x in want)
        assert Counter((*map(plain, r[:4]), *r[5:]) for r in got.collect()) == want
        few = ranked(df, ["g"], by, {"z": F.asc("z")}, at_most=40)
        assert Counter((*map(plain, r[:4]), *r[5:]) for r in few.collect()) == Counter({k: v for k, v in want.items() if k[5] <= 40})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_one_run_over_all_partitions(spark):
    df = spark.range(0, 5000, 1, 8).select(F.lit(1).alias("g"), F.lit(2).alias("x"), (F.col("id") % 3).alias("z"))
    got = ranked(df, ["g"], {"x": F.asc("x")}, {"z": F.asc("z")})
    assert got.agg(F.min("tied"), F.max("tied"), F.max("place"), F.max("dense"), F.count_distinct("pos"), F.max("pos")).first() == (5000, 5000, 1, 1, 5000, 5000)


def test_no_group_and_equal_rows_are_dealt_over_tasks(spark):
    df = spark.range(0, 40_000, 1, 4).select(F.lit(7).alias("x"))
    got = ranked(df, [], {"x": F.asc("x")})
    assert got.count() == 40_000 and got.agg(F.max("pos")).first()[0] == 40_000
    sizes = [r["count"] for r in df.withColumn("_s", F.monotonically_increasing_id()).repartitionByRange(4, "x", "_s").groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 15_000


def test_clashing_names_raise(spark):
    with pytest.raises(ValueError, match="pos"):
        ranked(spark.range(3).withColumn("POS", F.lit(1)), [], {"id": F.asc("id")})


def test_line_places_of_odd_rows(spark):
    schema = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz"
    rows = [(None, None, None, None, None, None, None, None, None)] * 3 + [(1, 1, 12, 3, 25, 1.005, 0.05, "kept", None), (1, 1, 12, 3, 25, 1.005, 0.05, "kept", None), (2, 1, 2, 3, 9, 2.0, 0.0, "kept", None)]
    df = spark.createDataFrame(rows, schema).withColumn("place", F.lit("clash"))
    got = sorted(line_places(df).collect(), key=str)
    assert len(got) == 6
    null = [r for r in got if r.vendor_id is None]
    assert [(r.part, r.month, r.place, r.tied) for r in null] == [(-1, -1, 1, 3)] * 3 and sorted(r.pos for r in null) == [1, 2, 3]
    assert line_places(df.where("false")).count() == 0
