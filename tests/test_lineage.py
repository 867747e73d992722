"""Lineage is looked up by the path of a file, which is decoded once for each file."""

from __future__ import annotations

from datetime import datetime

from millrace.plans import layers
from millrace.sources.landing import LandingFile


def test_rows_find_their_file_by_the_path_as_it_is_scanned(spark, tmp_path):
    names = ["a b.csv", "c+d.csv", "e%20f.csv", "g#h.csv", "ü.csv"]
    for n in names:
        (tmp_path / n).write_text(f"store_id,store_name\nS,{n}\n")
    df = layers.scanned(spark, "stores", [LandingFile(str(tmp_path / n), "stores", "2026-01-01", "r", n, "csv", n) for n in names], datetime(2026, 1, 1))
    assert sorted((r.store_name, r._source_file) for r in df.collect()) == sorted((n, n) for n in names)
    assert "url_decode" not in df._jdf.queryExecution().optimizedPlan().toString().lower()
