"""Indexes of files: what is opened and rewritten, against what holds a key."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.operators import dimensions as dims
from millrace.plans.warehouse import upsert_customers
from millrace.sources.filestats import Index, describe, holders
from millrace.sources.versioned import VersionedTable


@pytest.fixture
def many(spark, tmp_path):
    """200 files of 50 keys each, in the order of the key."""
    t = VersionedTable(spark, tmp_path / "t")
    t.overwrite(spark.range(0, 20_000, 2, 200).select("id", F.concat(F.lit("n"), "id").alias("name")))
    assert len(t.entry(0)["live"]) == 200
    return t


def contents(t):
    return {r.id: r.name for r in t.read().collect()}


def test_merge_opens_few_of_many_files(spark, many):
    want = contents(many)
    # 40 keys of two files, and 60 that lie within the ranges of other files but are in none
    ids = [(k,) for k in [*range(1000, 1040, 2), *range(15_000, 15_040, 2), *range(3001, 3121, 2)]]
    source = spark.createDataFrame(ids, "id long").withColumn("name", F.lit("new"))
    many.merge(source, "id")
    e = many.entry(1)
    assert e["opened"] < 5 and len(e["remove"]) == 2 and e["rows_added"] == 60
    assert contents(many) == want | {k: "new" for (k,) in ids}
    kept = set(many.entry(0)["live"]) - set(e["remove"])
    assert kept <= set(e["live"])
    many.merge(source.withColumn("name", F.lit("again")), "id")  # the index of the files that the merge wrote
    e = many.entry(2)
    assert e["opened"] < 5 and e["rows_added"] == 0 and contents(many) == want | {k: "again" for (k,) in ids}


def test_merges_over_a_compacted_index_equal_plain_ones(spark, many):
    want = contents(many)
    for n in range(1, 13):
        ids = [(k,) for k in range(n * 700, n * 700 + 30, 3)] + [(None,)]
        many.merge(spark.createDataFrame(ids, "id long").withColumn("name", F.lit(f"m{n}")), "id")
        want |= {k: f"m{n}" for (k,) in ids if k is not None}
        if n == 6:
            many.append(spark.range(50_001, 50_100, 2, 3).select("id", F.lit("late").alias("name")))
            want |= {k: "late" for k in range(50_001, 50_100, 2)}
    many.merge(spark.createDataFrame([(50_001, "x"), (4, "y")], "id long, name string"), "id")
    got = many.read()
    assert {r.id: r.name for r in got.where("id is not null").collect()} == want | {50_001: "x", 4: "y"}
    assert got.where("id is null").count() == 12  # a null key matches nothing
    e = many.entry(many.latest())
    assert e["opened"] <= 4 and len(e["index"]["id"]["paths"]) < 6
    assert set(e["live"]) == set(e["index"]["id"]["files"])


def test_holders_lose_no_file(spark, tmp_path):
    """Scattered string keys: every file that holds a key is named, and few others."""
    rows = spark.range(0, 30_000, 1, 30).select(F.sha2(F.col("id").cast("string"), 256).substr(1, 12).alias("k"), (F.col("id") % 3 == 0).alias("live"))
    rows.write.parquet(str(tmp_path / "data"))
    there = spark.read.parquet(str(tmp_path / "data"))
    for index in (Index("k"), Index("k", "live")):
        assert Index.named(index.name) == index
        describe(there, index, lambda p: F.element_at(F.split(p, "/"), -1)).write.mode("overwrite").parquet(str(tmp_path / "index"))
        known = spark.read.parquet(str(tmp_path / "index"))
        keys = there.where("k like '00%' or k like 'ff1%'").select("k").unionByName(spark.range(40).select(F.concat(F.lit("zz"), "id").alias("k")))
        hits = there.where("live" if index.where else "true").withColumn("file", F.element_at(F.split("_metadata.file_path", "/"), -1)).join(keys, "k", "left_semi")
        want = {r.file for r in hits.select("file").distinct().collect()}
        got = {r.file for r in holders(known, keys, "k").collect()}
        assert want <= got
        one = there.where("live").limit(1).select("k")
        few = {r.file for r in holders(known, one, "k").collect()}
        assert len(few) <= 2
        assert holders(known, keys.where("false"), "k").count() == 0


def test_history_is_revised_in_place(spark, tmp_path):
    def people(n, changed=()):
        rows = spark.range(n).select(F.format_string("CUST%06d", "id").alias("customer_id"), F.col("id"))
        for c in dims.PROFILE:
            if c not in rows.columns:
                rows = rows.withColumn(c, F.lit("x").cast("date" if "date" in c else "string") if "date" not in c else F.lit("2020-01-01").cast("date"))
        return rows.withColumn("loyalty_tier", F.when(F.col("id").isin(*changed or [-1]), "GOLD").otherwise("x")).drop("id")

    t = VersionedTable(spark, tmp_path / "dim")
    first = dims.scd2_initial(people(4000), "1990-01-01 00:00:00")
    t.overwrite(first.repartitionByRange(40, "customer_id"))
    was = t.entry(0)["live"]
    assert upsert_customers(t, people(4003, (7, 8, 2500)), datetime(2024, 1, 1), datetime(1990, 1, 1)) == "advanced"
    e = t.entry(1)
    assert len(e["remove"]) == 2 and e["opened"] < 5 and set(was) - set(e["remove"]) <= set(e["live"])
    want = dims.scd2_apply(t.read(version=0), people(4003, (7, 8, 2500)), datetime(2024, 1, 1))
    assert t.read().exceptAll(want).count() == 0 and want.exceptAll(t.read()).count() == 0
    # the next batch finds the new current versions by the index of current rows alone
    assert upsert_customers(t, people(4003, (8, 2500)), datetime(2024, 2, 1), datetime(1990, 1, 1)) == "advanced"
    want = dims.scd2_apply(t.read(version=1), people(4003, (8, 2500)), datetime(2024, 2, 1))
    assert t.read().exceptAll(want).count() == 0 and t.entry(2)["opened"] < 8
    assert upsert_customers(t, people(4003, (8, 2500)), datetime(2024, 3, 1), datetime(1990, 1, 1)) == "unchanged"
