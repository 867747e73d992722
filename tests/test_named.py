"""Versioned tables by name: the data source and tables of the catalog."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import datasource as api, functions as F

from millrace.plans.serving import register
from millrace.sources.named import ArrowLog, FilteringReader, create_table, drop_table, enable, expression
from millrace.sources.tablelog import TableNotFoundError
from millrace.sources.versioned import VersionedTable

SCHEMA = "k bigint, name string, d date, at timestamp, local timestamp_ntz, price decimal(10,2), ok boolean, tags array<string>, part struct<a:int,b:string>, x double"
ROWS = [
    (1, "a", date(2024, 1, 1), datetime(2024, 1, 1, 1), datetime(2024, 1, 1, 1), Decimal("1.50"), True, ["p", None], (1, "q"), 1.5),
    (2, "it's", date(1900, 1, 1), datetime(1950, 6, 1, 12, 30, 1, 5), datetime(1800, 1, 1), Decimal("-2.00"), False, [], (None, None), float("nan")),
    (3, None, None, None, None, None, None, None, None, None),
]


@pytest.fixture
def table(spark, tmp_path):
    enable(spark)
    t = VersionedTable(spark, tmp_path / "a 'table'")
    t.overwrite(spark.createDataFrame(ROWS, SCHEMA).repartition(2))
    t.append(spark.createDataFrame([(9, "new", 7)], "k bigint, name string, more int"), merge_schema=True)
    t.update(F.col("k") == 1, {"name": F.lit("A")})
    return t


def rows(df):
    return sorted(map(repr, df.collect()))


def test_source_equals_the_table(spark, table):
    read = lambda **o: spark.read.format("millrace").options(path=table.path, **o).load()
    assert rows(read()) == rows(table.read()) and read().schema == table.read().schema
    for v in table.versions():
        assert rows(read(version=v)) == rows(table.read(v))
    assert rows(read(as_of=table.entry(1)["timestamp"])) == rows(table.read(1))
    assert rows(read(columns="more, k")) == rows(table.read().select("more", "k"))
    assert read().count() == 4
    for bad in ({"version": 17}, {"columns": "none"}):
        with pytest.raises(Exception, match="17|none"):
            read(**bad)


def test_filters(spark, table):
    plain = table.read()
    df = spark.read.format("millrace").option("filters", "true").load(table.path)
    assert rows(spark.read.format("millrace").load(table.path).where("k = 2")) == rows(plain.where("k = 2"))
    for f in (
        "k = 2", "k > 1 and k <= 9", "k in (1, 3, 4)", "k not in (1, 2)", "name is null", "name is not null", "name = 'it''s'", "name <> 'A'", "d < date'2000-01-01'", "ok", "not ok",
        "at > timestamp'2000-01-01'", "price >= 1.5", "x > 1", "more = 7", "more is null", "more > 100", "part.a = 1", "name like 'n%'", "k = 1 or name = 'new'",
    ):
        assert rows(df.where(f)) == rows(plain.where(f)), f


def test_filters_skip_row_groups_and_columns_are_read_as_asked(spark, tmp_path):
    t = VersionedTable(spark, tmp_path / "t")
    t.overwrite(spark.range(0, 1000, 1, 1).select("id", F.lit("x").alias("name")))
    schema = spark.range(1).schema
    r = FilteringReader(t.path, t.entry(0)["live"], schema)
    assert list(r.pushFilters([api.GreaterThan(("id",), 5000)])) and [b.num_rows for b in r.read(r.partitions()[0]) if b.num_rows] == []
    r.pushFilters([api.EqualTo(("id",), 7), api.StringStartsWith(("id",), "x")])
    assert [b.to_pydict() for b in r.read(r.partitions()[0]) if b.num_rows] == [{"id": [7]}]
    assert expression(api.EqualTo(("a", "b"), 1), schema) is None and expression(api.EqualTo(("id",), True), schema) is None


def test_log_without_a_session(spark, table, tmp_path):
    log = ArrowLog(f"file://{table.path}")
    assert log.versions() == table.versions() and log.entry(2) == table.entry(2) and log.schema() == table.schema()
    with pytest.raises(TableNotFoundError):
        ArrowLog(str(tmp_path / "none")).latest()


def test_tables_of_the_catalog(spark, table):
    spark.sql("CREATE SCHEMA IF NOT EXISTS named_test")
    create_table(spark, "named_test.now", table.path)
    create_table(spark, "named_test.first", table.path, version=0, filters=True)
    other = spark.newSession()  # another session reads it by its name
    assert other.sql("SELECT count(*) AS n, sum(k) AS s FROM named_test.now").first()[:] == (4, 15)
    assert sorted(r.k for r in other.table("named_test.first").collect()) == [1, 2, 3]
    table.append(spark.createDataFrame([(100, "late")], "k bigint, name string"))
    assert other.sql("SELECT name FROM named_test.now WHERE k = 100").first()[0] == "late"
    assert other.table("named_test.first").where("k > 1").count() == 2
    table.append(spark.createDataFrame([(101, 5)], "k bigint, newer int"), merge_schema=True)
    assert other.table("named_test.now").count() == 6 and "newer" not in other.table("named_test.now").columns
    create_table(spark, "named_test.now", table.path)
    assert other.sql("SELECT newer FROM named_test.now WHERE k = 101").first()[0] == 5
    drop_table(spark, "named_test.now")
    assert table.read().count() == 6 and not spark.catalog.tableExists("named_test.now")
    table.overwrite(table.read().where("false"))
    create_table(spark, "named_test.now", table.path)
    assert spark.table("named_test.now").count() == 0


def test_layers_are_registered(spark, tmp_path):
    VersionedTable(spark, tmp_path / "gold" / "kpi").overwrite(spark.range(3))
    layers = {"gold": ("kpi", "missing")}
    assert register(spark, str(tmp_path), "named", layers, persistent=True) == ["named_gold.kpi"]
    assert spark.newSession().sql("SELECT max(id) FROM named_gold.kpi").first()[0] == 2
    assert register(spark, str(tmp_path), "named", layers) == ["gold_kpi"] and spark.table("gold_kpi").count() == 3
