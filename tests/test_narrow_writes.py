"""What queries write on the way holds the columns that are looked at later, and no others."""

from __future__ import annotations

import os

import pytest
from test_cut_ids import both, wide  # noqa: F401

from millrace import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
KEYS = {"customer_key", "product_key", "store_key", "order_date_key"}


@pytest.fixture
def written(monkeypatch):
    """Columns of what queries write, by name."""
    seen, write = {}, queries._written

    def watched(spark, name, df):
        seen[name] = set(df.columns)
        return write(spark, name, df)

    monkeypatch.setattr(queries, "_written", watched)
    return seen


@pytest.mark.parametrize(
    ("name", "columns"),
    [("quality_ri", KEYS), ("quality_unknown", KEYS | {"order_item_id", "order_id"}), ("quality_completeness", KEYS | {"order_item_id", "order_id", "net_amount"}), ("quality_uniqueness", KEYS | {"order_item_id", "order_id"})],
)
def test_checks_keep_the_columns_of_facts_that_they_look_at(spark, wide, written, name, columns):  # noqa: F811
    got, want = both(spark, wide, name)
    assert got == want
    assert written["fact_sales"] == columns and "fact_returns" not in written


def test_quality_metrics_keep_reasons_and_what_references_read(spark, wide, written):  # noqa: F811
    got, want = both(spark, wide, "quality_metrics")
    assert got == want
    assert written["customers"] == {"customer_id", "_reason"} and written["orders"] == {"order_id", "total_amount", "_reason"} and written["payments"] == {"_reason"}


def test_the_hash_that_breaks_ties_takes_half_the_bytes(spark, wide):  # noqa: F811
    plan = queries.QUERIES["conform_batch_payments"](spark, wide[0])._jdf.queryExecution().optimizedPlan().toString()
    assert "unhex(sha2(" in plan
