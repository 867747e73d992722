from __future__ import annotations

import json
from datetime import datetime

import pytest

from millrace.operators.checks import QualityGateError
from millrace.plans import jobfile, jobs, layers
from millrace.plans.batch import register_views, run_batch, run_reports
from millrace.operators.dimensions import unknown_member
from millrace.plans.serving import STAR_VIEWS, create_views, register
from millrace.plans.jobs import RetryPolicy, Run, Task, classify, ordered, run_job
from millrace.sources import landing
from millrace.sources.generator import seed_landing, tables, write_files
from millrace.sources.versioned import VersionedTable
from millrace.streaming.landing import ingest_available

DAY = "2026-01-05"


@pytest.fixture(scope="module")
def delivered(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("landing"))
    seed_landing(spark, root, DAY, "r1")
    return root


def test_path_contract():
    f = landing.parse_path(f"/x/retail/orders/ingestion_date={DAY}/run_id=r1/a.csv")
    assert (f.dataset, f.ingestion_date, f.run_id, f.file_format) == ("orders", DAY, "r1", "csv")
    for bad in ("/x/orders.csv", "/x/retail/orders/ingestion_date=2026-02-31/run_id=r/a.csv", f"/x/retail/orders/ingestion_date={DAY}/run_id=/a.csv", f"/x/retail//ingestion_date={DAY}/run_id=r/a.csv", f"/x/retail/orders/ingestion_date={DAY}/run_id=r/a.xlsx"):
        with pytest.raises(landing.LandingPathError):
            landing.parse_path(bad)
    assert landing.parse_path("/x/orders.csv", strict=False).dataset == "orders"
    assert landing.ingestion_id("Orders", "/X/a", "s") == landing.ingestion_id("orders", "/x/A", "s") != landing.ingestion_id("orders", "/x/a", "t")
    assert landing.joined_uri("abfss://c@a/", "x", "/y/") == "abfss://c@a/x/y"
    assert "hunter2" not in landing.redacted("password=hunter2;sig=abc") and "abc" not in landing.redacted("sig=abc")


def test_discovery_and_completeness(spark, delivered):
    files = landing.discover(spark, delivered)
    assert len(files) == 8 and all(f.sha256 and len(f.sha256) == 64 for f in files)
    assert len(landing.assert_complete(files, DAY)) == 8
    with pytest.raises(landing.LandingIncompleteError):
        landing.assert_complete(files[:3], DAY)
    assert landing.discover(spark, delivered + "/none") == []
    m = landing.manifest(spark, files)
    done = spark.createDataFrame([(files[0].ingestion_id, "x", "SUCCESS"), ("y", files[1].path, "SUCCESS"), (files[2].ingestion_id, "z", "FAILED")], "ingestion_id string, source_path string, status string")
    assert landing.pending(m, done).count() == 6
    assert landing.batch(m, DAY, "other").count() == 0


def test_job_end_to_end_and_again(spark, delivered, tmp_path):
    run = Run(spark, delivered, str(tmp_path), DAY, threshold=0.5, allow_unknown=True)
    done = run_job(run)
    assert {o.state for o in done.values()} == {"SUCCESS"}, jobs.report(done)
    files = landing.discover(spark, delivered)
    assert sum(layers.ingest_bronze(spark, str(tmp_path), files).values()) == 0
    before = layers.load(spark, str(tmp_path), "bronze", "orders").count()
    # the audit is lost after the data was committed: nothing is added twice, and the audit comes back
    layers.audit_table(spark, str(tmp_path)).overwrite(layers.audit_table(spark, str(tmp_path)).read().where("false"))
    assert sum(layers.ingest_bronze(spark, str(tmp_path), files).values()) == 0
    assert layers.load(spark, str(tmp_path), "bronze", "orders").count() == before
    assert layers.audit_table(spark, str(tmp_path)).read().count() == 8
    again = Run(spark, delivered, str(tmp_path), DAY, threshold=0.5, allow_unknown=True)
    assert {o.state for o in run_job(again).values()} == {"SUCCESS"}
    audit = VersionedTable(spark, f"{tmp_path}/operations/job_run_audit").read()
    assert audit.count() == 2 and {r.final_status for r in audit.collect()} == {"SUCCESS"}
    views = register(spark, str(tmp_path))
    assert len(views) == 8 + 16 + 6 + 8 + 2 and spark.table("gold_gold_monthly_revenue").count() > 0
    tables = {n: layers.load(spark, str(tmp_path), "warehouse", n) for n in ("dim_date", "dim_customer", "dim_product", "dim_store", "fact_sales", "fact_returns")}
    whole = tables | {n: unknown_member(tables[n], k) for n, k in (("dim_customer", "customer_key"), ("dim_product", "product_key"), ("dim_store", "store_key"))}
    assert create_views(spark, whole, STAR_VIEWS) == ["sales_detail", "returns_detail"]
    assert spark.table("sales_detail").count() == tables["fact_sales"].count() and spark.table("returns_detail").count() == tables["fact_returns"].count()
    dim = layers.load(spark, str(tmp_path), "warehouse", "dim_customer")
    assert dim.count() == dim.select("customer_id").distinct().count()


def test_silver_takes_one_execution_for_each_output_and_a_second_snapshot_leaves_the_rate(spark, delivered, tmp_path):
    root = str(tmp_path)
    layers.ingest_bronze(spark, root, landing.discover(spark, delivered))
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    first = layers.build_silver(spark, root, supersede=True)
    assert store.executionsCount() == before + 2 * len(first)
    again = str(tmp_path / "landing")
    seed_landing(spark, again, "2026-01-06", "r2")
    layers.ingest_bronze(spark, root, landing.discover(spark, again))
    second = layers.build_silver(spark, root, supersede=True)
    for name, n in first.items():
        m = second[name]
        assert m["bronze"] == 2 * n["bronze"] and m["redelivered"] == n["bronze"] and n["redelivered"] == 0
        assert m["valid"] == n["valid"] and m["quarantine"] - m["redelivered"] == n["quarantine"]
        assert VersionedTable(spark, f"{root}/bronze/{name}").rows() == layers.load(spark, root, "bronze", name).count() == m["bronze"]


def test_threshold_is_strict_and_values_are_published(spark, delivered, tmp_path):
    run = Run(spark, delivered, str(tmp_path), DAY, threshold=0.0)
    done = run_job(run)
    assert done["silver"].state == "FAILED" and done["silver"].failure == "DATA_QUALITY" and done["gold"].state == "SKIPPED"
    assert run.values.get("silver", "alert") and run.values.get("silver", "valid") > 0
    assert jobs.root_failure(done).task == "silver"


def test_gold_and_warehouse_are_independent(spark, tmp_path):
    ran = []

    def fail(_):
        raise QualityGateError("x")

    graph = (Task("a", lambda _: ran.append("a")), Task("gold", fail, ("a",)), Task("warehouse", lambda _: ran.append("w"), ("a",)), Task("end", lambda _: ran.append("e"), ("gold", "warehouse")))
    done = run_job(Run(spark, "", str(tmp_path), DAY), graph)
    assert ran == ["a", "w"] and done["end"].state == "SKIPPED"
    with pytest.raises(ValueError, match="cycle"):
        ordered((Task("x", fail, ("y",)), Task("y", fail, ("x",))))


def test_only_passing_faults_are_retried():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) == 1:
            raise TimeoutError("slow")
        return "ok"

    assert RetryPolicy(1, 0).run(flaky) == ("ok", 1)
    with pytest.raises(ValueError):
        RetryPolicy(3, 0).run(lambda: (_ for _ in ()).throw(ValueError("x")))
    assert [classify(e) for e in (QualityGateError("x"), ConnectionError("x"), ValueError("x"), landing.LandingIncompleteError("x"), RuntimeError("odd"))] == ["DATA_QUALITY", "TRANSIENT", "CONFIGURATION", "DEPENDENCY", "UNKNOWN"]


def test_batch_pipeline_and_reports(spark, tmp_path):
    write_files(spark, f"{tmp_path}/in", "sample")
    metrics = run_batch(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    assert len(metrics) == 8 and all(m.source_row_count == m.valid_row_count + m.quarantine_row_count for m in metrics.values())
    register_views(spark, f"{tmp_path}/out")
    assert all(df.count() >= 0 for df in run_reports(spark).values())
    assert spark.read.parquet(f"{tmp_path}/out/metrics").count() == 8


def test_generator_is_deterministic(spark):
    a, b = tables(spark, "sample"), tables(spark, "sample")
    assert all(sorted(map(str, a[n].collect())) == sorted(map(str, b[n].collect())) for n in ("customers", "order_items"))
    assert tables(spark, "sample", 7)["customers"].collect() != a["customers"].collect()


def test_stream_ingests_once(spark, delivered, tmp_path):
    for _ in range(2):
        ingest_available(spark, delivered, str(tmp_path), "stores").awaitTermination()
    rows = layers.load(spark, str(tmp_path), "bronze", "stores")
    assert rows.count() == 3 and rows.first()["_adf_run_id"] == "r1"


def test_summary_runs_whatever_happens_and_names_the_cause(spark, tmp_path):
    def fail(_):
        raise QualityGateError("bad rows")

    run = Run(spark, "", str(tmp_path), DAY, job_id="j1", job_run_id="r9")
    done = run_job(run, (Task("a", fail), Task("b", lambda _: None, ("a",))))
    assert [o.state for o in done.values()] == ["FAILED", "SKIPPED", "SUCCESS"]
    row = VersionedTable(spark, f"{tmp_path}/operations/job_run_audit").read().first()
    assert (row.final_status, row.failure_task, row.failure_classification, row.error_message, row.job_id, row.job_run_id) == ("FAILED", "a", "DATA_QUALITY", "bad rows", "j1", "r9")
    assert len(row) == 23
    lost = Run(spark, "", str(tmp_path), DAY, tasks=("a", "b"))
    lost.values.set("a", "state", "SUCCESS")
    assert jobs.root_cause(lost)[:2] == ("b", "UNKNOWN")


def test_final_gate_looks_at_all_layers(spark, tmp_path):
    run = Run(spark, "", str(tmp_path), DAY)
    good = {("validate_landing", "datasets"): 8, ("bronze", "rows"): 0, ("silver", "valid"): 5, ("silver", "alert"): False, ("gold", "tables"): 6, ("warehouse", "quality"): "PASSED", ("warehouse", "fact_sales"): 3}
    for (t, k), v in good.items():
        run.values.set(t, k, v)
    jobs.final_gate(run)
    for (t, k), v in good.items():
        run.values.set(t, k, None)
        with pytest.raises(jobs.FinalGateError, match=t.split("_")[-1]):
            jobs.final_gate(run)
        run.values.set(t, k, v)


def test_job_files():
    good = jobfile.job_file()
    assert jobfile.checked(good)["task_keys"][-1] == "publish_summary" and jobfile.checked(json.dumps({"resources": good}))["job_key"] == "retail"

    def spoiled(change):
        d = json.loads(json.dumps(good))
        change(d["jobs"]["retail"])
        return " ".join(jobfile.problems(d))

    def task(j, name):
        return next(t for t in j["tasks"] if t["task_key"] == name)

    for change, what in (
        (lambda j: task(j, "bronze")["depends_on"].append({"task_key": "gold"}), "cycle"),
        (lambda j: j["tasks"].append(j["tasks"][0]), "twice"),
        (lambda j: task(j, "gold")["depends_on"].append({"task_key": "nowhere"}), "nowhere"),
        (lambda j: j["tasks"].remove(task(j, "gold")), "gold"),
        (lambda j: j["parameters"].pop(), "catalog_name"),
        (lambda j: task(j, "publish_summary").pop("run_if"), "ALL_DONE"),
        (lambda j: task(j, "gold").update(condition_task={"op": "EQ"}), "condition"),
        (lambda j: task(j, "gold")["depends_on"][0].update(outcome="maybe"), "maybe"),
        (lambda j: j.update(tag="{{run_id}}"), "out of use"),
        (lambda j: j.update(tag="{{secrets.x}}"), "must begin"),
        (lambda j: j.update(path="/mnt/x"), "mount"),
        (lambda j: j.update(owner="some.body@work.org"), "address"),
        (lambda j: j.update(tasks=[]), "no tasks"),
    ):
        assert what in spoiled(change), what
    assert jobfile.problems("{") and jobfile.problems("{}") == ["it has no jobs"]


def test_merges_into_silver(spark, tmp_path):
    customers = spark.createDataFrame([("C1", "a"), ("C2", "b")], "customer_id string, city string")
    layers.merge_customers(spark, str(tmp_path), customers)
    layers.merge_customers(spark, str(tmp_path), spark.createDataFrame([("C2", "B"), ("C3", "c")], "customer_id string, city string"))
    assert sorted(map(tuple, layers.load(spark, str(tmp_path), "silver", "customers").collect())) == [("C1", "a"), ("C2", "B"), ("C3", "c")]
    layers.merge_products(spark, str(tmp_path), spark.createDataFrame([("P1", 1)], "product_id string, n int"))
    layers.merge_orders(spark, str(tmp_path), spark.createDataFrame([("O1", 1)], "order_id string, n int"))
    assert layers.load(spark, str(tmp_path), "silver", "orders").count() == 1


def test_large_files_are_hashed_as_streams(spark, tmp_path, monkeypatch):
    write_files(spark, f"{tmp_path}/in", "sample")
    whole = landing.discover(spark, f"{tmp_path}/in", strict=False)
    monkeypatch.setattr(landing, "VALUE_BYTES", 2000)
    assert landing.discover(spark, f"{tmp_path}/in", strict=False) == whole and all(f.sha256 for f in whole)


def test_many_files_are_one_scan(spark, tmp_path):
    files = []
    for k in range(6):
        (tmp_path / f"in {k}+.csv").write_text(("store_id,store_name\n" if k < 5 else "store_name,store_id,more\n") + f"S{k},n{k}" + (",x" if k == 5 else "") + "\n")
        files.append(landing.LandingFile(str(tmp_path / f"in {k}+.csv"), "stores", DAY, "r", f"in {k}+.csv", "csv", str(k)))
    df = layers.scanned(spark, "stores", files, datetime(2026, 1, 1))
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 2
    assert sorted((r.store_id, r._source_file) for r in df.collect()) == sorted([*((f"S{k}", f"in {k}+.csv") for k in range(5)), ("n5", "in 5+.csv")])
