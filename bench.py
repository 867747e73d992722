"""Times the headline queries and prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose tables and cores."""

from __future__ import annotations

import json
import os
import sys
import time

from millrace.queries import QUERIES
from millrace.session import session

HEADLINE = [
    "revenue_by_region_channel", "daily_revenue", "top_products_per_category", "category_return_rate", "curated_sales_lines", "conform_batch_customers", "conform_silver_order_items", "dedup_latest_lineitem",
    "gold_daily", "gold_category", "gold_customer", "surrogate_keys_initial", "scd2_incremental", "upsert_merge", "fact_sales_pit", "star_sales_by_tier", "quality_completeness", "merge_read",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in sys.argv[1:] or HEADLINE:
        begin = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - begin, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
