"""A merge whose keys are many, or beyond all files, builds no filters."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.sources.versioned import VersionedTable


@pytest.mark.parametrize(("keys", "opened"), [("id % 3 = 0 and id < 2000", 20), ("id >= 2000", 0)])
def test_no_filters_where_they_tell_nothing(spark, tmp_path, keys, opened):
    t = VersionedTable(spark, tmp_path / "t")
    t.overwrite(spark.range(0, 2000, 1, 20).select("id", F.lit("old").alias("name")))
    t.merge(spark.range(3000).where(keys).select("id", F.lit("new").alias("name")), "id")
    e = t.entry(1)
    assert e["index"] == {} and e["opened"] == opened
    got = t.read()
    assert got.where("name = 'new'").count() == spark.range(3000).where(keys).count() and got.select("id").distinct().count() == got.count()
