"""Windows in blocks against plain windows."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window, functions as F

from millrace.operators.blocks import as_of, blocked, dense_ranks, running


@pytest.fixture(scope="module")
def orders(spark):
    """Half of all orders are one customer's; moments repeat, some are null; one customer is null."""
    rng = random.Random(5)
    begin = datetime(2024, 1, 1)
    rows = []
    for n in range(3000):
        who = None if n % 50 == 0 else "hot" if n % 2 else f"c{rng.randrange(40)}"
        rows.append((who, None if n % 97 == 0 else begin + timedelta(hours=rng.randrange(900)), n, rng.choice([None, 1, 2, 5]), rng.choice([None, "x", "y"])))
    return spark.createDataFrame(rows, "who string, at timestamp, id long, spend long, tag string").withColumn("_block", F.lit("kept")).cache()


def counted(df):
    return Counter(map(tuple, df.collect()))


def test_blocks_split_the_hot_group(spark, orders):
    cut, several = blocked(orders, ["who"], F.col("at"), "b", rows=100)
    sizes = {(r.who, r.b): r["count"] for r in cut.groupBy("who", "b").count().collect()}
    hot = sorted(n for (who, _), n in sizes.items() if who == "hot")
    assert several and sum(hot) == 1500 - 0 and hot[-1] < 1500 / 4
    assert all(b == 0 for who, b in sizes if who not in (None, "hot"))
    assert not blocked(orders, ["who"], F.col("at"), "b")[1]


@pytest.mark.parametrize("rows", [40, 10**6])
def test_running(spark, orders, rows):
    got = running(orders, ["who"], "at", ["id"], "n", {"total": "spend"}, {"was": "at", "tag_was": "tag"}, rows)
    w = Window.partitionBy("who").orderBy("at", "id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = orders.select("*", F.row_number().over(w).alias("n"), F.sum("spend").over(upto).alias("total"), F.lag("at").over(w).alias("was"), F.lag("tag").over(w).alias("tag_was"))
    assert got.columns == want.columns and counted(got) == counted(want)
    assert running(orders.where("false"), ["who"], "at", ["id"], "n", {"total": "spend"}, {}, rows).count() == 0


def test_running_windows_see_blocks(spark, orders):
    plan = running(orders, ["who"], "at", ["id"], "n", {"total": "spend"}, {}, 40)._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(who" in plan and "_block_" in plan


@pytest.mark.parametrize("rows", [10, 10**6])
@pytest.mark.parametrize("descending", [False, True])
def test_dense_ranks(spark, orders, rows, descending):
    df = orders.withColumn("v", F.when(F.col("id") % 11 != 0, F.pmod(F.xxhash64("id"), F.lit(300))))
    got = dense_ranks(df, ["who"], "v", "r", descending, rows)
    order = F.desc("v") if descending else F.asc("v")
    want = df.withColumn("r", F.dense_rank().over(Window.partitionBy("who").orderBy(order)))
    assert got.columns == want.columns and counted(got) == counted(want)


def versions(spark, hot, gaps):
    """A key of many versions with gaps, keys of a few, zero-length ones, a null key."""
    begin = datetime(2024, 1, 1)
    rows = [("hot", begin + timedelta(hours=k), begin + timedelta(hours=k + (0 if k % 13 == 0 else 1 if k % 7 or not gaps else 0.5)), k) for k in range(0, hot)]
    rows += [("hot", begin + timedelta(hours=hot), None, hot)]
    rows += [(f"c{k}", begin + timedelta(hours=100), None, -k) for k in range(0, 40, 2)] + [(None, begin, None, 7), ("c1", None, None, 8)]
    return spark.createDataFrame(rows, "k string, since timestamp, until timestamp, version long")


@pytest.mark.parametrize(("rows", "few"), [(60, 0), (10**6, 0), (10**6, 10**6)])
def test_as_of(spark, orders, rows, few):
    v = versions(spark, 500, True)
    got = as_of(orders, v, "who", "at", "k", "since", "until", ["version"], rows, few)
    valid = (F.col("who") == F.col("k")) & (F.col("at") >= F.col("since")) & (F.col("until").isNull() | (F.col("at") < F.col("until")))
    want = orders.join(v, valid, "left").select(*orders.columns, "version")
    assert got.columns == want.columns and counted(got) == counted(want)
    none = as_of(orders, v.where("false"), "who", "at", "k", "since", "until", ["version"], rows, few)
    assert none.count() == 3000 and none.where("version is not null").count() == 0


def test_a_key_of_many_versions_multiplies_no_rows(spark):
    """100 000 versions of one key and as many facts: no operator of the plan makes more rows than both have."""
    begin = F.lit("2024-01-01").cast("timestamp")
    at = lambda c: F.timestamp_add("SECOND", c.cast("int"), begin)
    v = spark.range(100_000).select(F.lit("k").alias("k"), at(F.col("id") * 2).alias("since"), at(F.col("id") * 2 + 2).alias("until"), "id")
    facts = spark.range(0, 200_000, 2).select(F.lit("k").alias("who"), at(F.col("id") + 1).alias("at"), (F.col("id") / 2).cast("long").alias("want"))
    got = as_of(facts, v, "who", "at", "k", "since", "until", ["id"], rows=20_000)
    assert got.where("id = want").count() == 100_000
    assert "valid" not in got._jdf.queryExecution().optimizedPlan().toString() and got.count() == 100_000
