from __future__ import annotations

import pytest
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def corpus(spark):
    """(doc_id, text) of the smallest documents table."""
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeats, and extra columns with clashing names."""
    rows = [(1, None), (2, ""), (3, "   \n"), (4, "plain words of a short text"), (5, "plain words of a short text"), (6, "x" * 40_000), (7, "one two three four five six seven " * 900), (None, "no id here at all"), (8, "ÄÖ ß 日本語 😀 ́ tail"), (4, "plain words of a short text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"fp": F.lit(None).cast("string"), "hash": F.lit("h"), "score": F.lit(None).cast("double"), "lang": F.lit(None).cast("string"), "ids": F.lit(1), "class_id": F.lit("c"), "bands": F.lit("b"), "_gone": F.lit(1), "marks": F.lit(2), "base": F.lit(3), "n": F.lit(4)})


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
