"""Jobs that a change of their SQL had made smaller: what they have to find, told from the tables alone."""

from __future__ import annotations

from test_queries import DATA, pytestmark  # noqa: F401

from millrace.queries import QUERIES


def test_a_tenth_of_the_customers_is_unknown_to_the_probe(spark):
    orders = spark.read.parquet(f"{DATA}/orders.parquet").select("o_orderkey", "o_custkey").collect()
    got = QUERIES["orphan_probe_anti"](spark, DATA).collect()
    assert sorted(map(tuple, got)) == sorted(tuple(r) for r in orders if r.o_custkey % 10 == 3)


def test_a_third_of_the_customers_gets_keys_after_the_others(spark):
    ids = sorted(f"CUST-{r.c_custkey:06d}" for r in spark.read.parquet(f"{DATA}/customer.parquet").collect())
    first = [i for i in ids if int(i[5:]) % 3]
    late = [i for i in ids if not int(i[5:]) % 3]
    got = {r.customer_id: r.customer_key for r in QUERIES["surrogate_keys_incremental"](spark, DATA).collect()}
    assert got == {c: k for k, c in enumerate([*first, *late], 1)}
