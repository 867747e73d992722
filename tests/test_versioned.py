from __future__ import annotations

from datetime import UTC, datetime

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from millrace.sources.versioned import AmbiguousMergeError, ConcurrentCommitError, SchemaMismatchError, TableNotFoundError, VersionedTable, merged


def people(spark, *rows):
    return spark.createDataFrame(list(rows), "id long, name string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_versions_and_time_travel(spark, tmp_path):
    t = VersionedTable(spark, tmp_path / "t")
    assert not t.exists()
    with pytest.raises(TableNotFoundError):
        t.read()
    t.overwrite(people(spark, (1, "a"), (2, "b")))
    between = datetime.now(UTC)
    t.append(people(spark, (3, "c")))
    assert t.read().count() == 3 == t.rows() and t.rows(0) == 2 and rows(t.read(version=0)) == [(1, "a"), (2, "b")] == rows(t.read(as_of=between))
    assert [(r.version, r.operation, r.rows_added) for r in t.history().collect()] == [(1, "APPEND", 1), (0, "OVERWRITE", 2)]
    assert [e["version"] for e in t.log()] == [0, 1]
    with pytest.raises(TableNotFoundError):
        t.read(version=9)


def test_schema_is_enforced_and_evolves(spark, tmp_path):
    t = VersionedTable(spark, tmp_path / "t")
    t.overwrite(people(spark, (1, "a")))
    wide = spark.createDataFrame([(2, "b", 5)], "id long, name string, age int")
    with pytest.raises(SchemaMismatchError):
        t.append(wide)
    with pytest.raises(SchemaMismatchError):
        t.append(spark.createDataFrame([("x", "y")], "id string, name string"), merge_schema=True)
    t.append(wide, merge_schema=True)
    assert rows(t.read().select("id", "age").fillna(-1)) == [(1, -1), (2, 5)]


def test_merge(spark, tmp_path):
    t = VersionedTable(spark, tmp_path / "t")
    t.merge(people(spark, (1, "a"), (2, "b")), "id")
    t.merge(people(spark, (1, "a"), (2, "b")), "id")
    t.merge(people(spark, (2, "B"), (3, "c")), "id")
    assert rows(t.read()) == [(1, "a"), (2, "B"), (3, "c")]
    t.merge(people(spark, (3, "C")), "id", lambda a, b: F.lit(False))
    assert rows(t.read())[2] == (3, "c")
    with pytest.raises(AmbiguousMergeError):
        t.merge(people(spark, (1, "x"), (1, "y")), "id")
    t.update(F.col("id") == 1, {"name": F.lit("z")})
    assert rows(t.read())[0] == (1, "z")


def test_one_row_rewrites_one_file(spark, tmp_path):
    t = VersionedTable(spark, tmp_path / "t")
    t.overwrite(spark.range(0, 4000, 1, 8).selectExpr("id", "cast(id as string) as name"))
    before = t.entry(0)["live"]
    t.merge(people(spark, (17, "new")), "id")
    e = t.entry(1)
    assert len(before) == 8 and len(e["remove"]) == 1 and set(before) - set(e["remove"]) < set(e["live"])
    t.merge(people(spark, (9000, "far"), (9001, "off")), "id")
    assert t.entry(2)["remove"] == [] and t.entry(2)["rows_added"] == 2 and e["rows_added"] == 0
    t.update(F.col("id") == 2500, {"name": F.lit("set")})
    assert len(t.entry(3)["remove"]) == 1
    t.update(F.col("id") < 0, {"name": F.lit("no")})
    assert t.entry(4)["remove"] == [] == t.entry(4)["add"]
    got = dict(rows(t.read()))
    assert len(got) == 4002 == t.rows() and [t.rows(v) for v in range(4)] == [4000, 4000, 4002, 4002] and (got[17], got[18], got[9000], got[2500]) == ("new", "18", "far", "set")
    assert t.read(version=0).count() == 4000 and dict(rows(t.read(version=0)))[17] == "17"


def test_log_grows_by_what_changes_and_broken_entries_are_passed_over(spark, tmp_path):
    t = VersionedTable(spark, tmp_path / "t")
    for k in range(23):
        t.append(people(spark, (k, "x")))
    assert [v for v in t.versions() if "live" in t._parsed(v)] == [0, 10, 20]
    assert t.read(version=14).count() == 15 and t.read().count() == 23
    (tmp_path / "t" / "_log" / f"{23:020d}.json").write_text('{"version": 23, "li')
    (tmp_path / "t" / "_log" / f"{24:020d}.json").write_text("")
    again = VersionedTable(spark, tmp_path / "t")
    assert again.latest() == 22 and again.read().count() == 23
    again.append(people(spark, (99, "y")))
    assert again.latest() == 25 and VersionedTable(spark, tmp_path / "t").read().count() == 24
    assert not [p for p in (tmp_path / "t" / "_log").iterdir() if p.name.endswith(".tmp")]


def test_lost_race(spark, tmp_path):
    a, b = VersionedTable(spark, tmp_path / "t"), VersionedTable(spark, tmp_path / "t")
    a.overwrite(people(spark, (1, "a")))
    base = b.latest()
    a.append(people(spark, (2, "b")))
    with pytest.raises(ConcurrentCommitError):
        b.replace(people(spark, (9, "z")), "MERGE", base)
    assert a.read().count() == 2


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.integers(0, 6), st.text("ab", max_size=2), max_size=5), st.dictionaries(st.integers(0, 6), st.text("ab", max_size=2), max_size=5))
def test_merge_is_a_dict_update(spark, old, new):
    got = merged(people(spark, *old.items()), people(spark, *new.items()), "id")
    assert dict(rows(got)) == old | new
