"""A merge writes its source once, as data of the table; only rows that have none of its keys, in files that have one, are copied."""

from __future__ import annotations

import pytest
from pyspark.sql import DataFrameWriter

from millrace.sources.versioned import AmbiguousMergeError, VersionedTable


@pytest.fixture
def written(monkeypatch):
    calls, plain = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: (calls.append(path), plain(self, path, *a, **k))[1])
    return calls


def rows(spark, at, first, last, value):
    return spark.range(first, last, numPartitions=2).selectExpr("id as k", f"'{value}' as v")


def test_a_merge_of_every_row_writes_it_once(spark, tmp_path, written):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.merge(rows(spark, t, 0, 100, "a"), "k")
    t.merge(rows(spark, t, 0, 100, "b"), "k")
    assert len(written) == 2
    assert {(r.k, r.v) for r in t.read().collect()} == {(k, "b") for k in range(100)}
    assert t.entry(1)["rows_added"] == 0 and t.rows() == 100 and t.read(version=0).where("v = 'a'").count() == 100


def test_rows_without_a_key_of_the_source_stay(spark, tmp_path, written):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.overwrite(rows(spark, t, 0, 100, "a").unionByName(spark.sql("select cast(null as bigint) as k, 'a' as v")).coalesce(1))
    t.append(rows(spark, t, 1000, 1100, "a").coalesce(1))
    kept = set(t.entry(1)["add"])
    t.merge(rows(spark, t, 50, 150, "b").unionByName(spark.sql("select cast(null as bigint) as k, 'b' as v")), "k")
    got = sorted((r.k is None, r.k or 0, r.v) for r in t.read().collect())
    want = [(False, k, "b" if 50 <= k < 150 else "a") for k in (*range(150), *range(1000, 1100))] + [(True, 0, "a"), (True, 0, "b")]
    assert got == sorted(want)
    assert kept <= set(t.entry(2)["live"]) and t.entry(2)["rows_added"] == 51 and len(written) == 4


def test_a_source_with_a_repeated_key_leaves_nothing(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    with pytest.raises(AmbiguousMergeError):
        t.merge(rows(spark, t, 0, 10, "a").unionByName(rows(spark, t, 9, 12, "b")), "k")
    assert not t.exists() and not [f for f in (tmp_path / "t").rglob("*.parquet")]


def test_columns_are_those_of_the_table(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.overwrite(rows(spark, t, 0, 10, "a"))
    t.merge(spark.range(5, 15).selectExpr("'b' as v", "cast(id as int) as k"), "k")
    assert t.read().schema["k"].dataType.simpleString() == "bigint"
    assert sorted((r.k, r.v) for r in t.read().collect()) == [(k, "a" if k < 5 else "b") for k in range(15)]
