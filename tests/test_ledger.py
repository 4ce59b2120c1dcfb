from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from snapdelta.operators.dashboard import duration_stats, run_event, status_timechart, top_failing
from snapdelta.operators.gates import canary_gate, slo_gate
from snapdelta.operators.ledger import (
    NotFound,
    UnknownStatus,
    catalog_page,
    catalog_page_info,
    catalog_report,
    checkpoint_of,
    connector_detail,
    connector_health,
    filter_runs,
    mttr_seconds,
    next_success,
    ops_snapshot,
    ops_summary,
    page_info,
    run_detail,
    run_rows,
    runs_page,
    slo_metrics,
)
from snapdelta.operators.quantile import exact_percentile
from snapdelta.operators.reconcile import pass_rates, reconcile, regressions

NOW = datetime(2026, 2, 16, 12, tzinfo=timezone.utc)
RUN = (
    "run_id string, connector_id string, status string, started_at timestamp, finished_at timestamp, "
    "upserts_count bigint, deletes_count bigint, error_class string, error_message string"
)


def ago(**gap):
    return NOW - timedelta(**gap)


def runs(spark, *rows):
    full = [(*row, *([None] * (9 - len(row)))) for row in rows]
    return spark.createDataFrame(full, RUN)


def checkpoints(spark, *rows):
    return spark.createDataFrame(list(rows), "connector_id string, watermark string, updated_at timestamp")


def batches(spark, *rows):
    return spark.createDataFrame(list(rows), "run_id string, connector_id string, status string, created_at timestamp")


def catalog(spark, *rows):
    return spark.createDataFrame(list(rows), "connector_id string, path string, mode string, schedule string, source_type string")


def test_slo_golden_case(spark):
    ledger = runs(
        spark,
        ("r1", "hr", "FAILED", ago(hours=2), ago(hours=2) + timedelta(minutes=5)),
        ("r2", "hr", "SUCCESS", ago(hours=2) + timedelta(minutes=15), ago(hours=1)),
        ("r3", "kb", "SUCCESS", ago(hours=1), ago(minutes=50)),
    )
    marks = checkpoints(spark, ("hr", "a", ago(hours=1)), ("kb", "b", ago(minutes=30)))
    row = slo_metrics(ledger, marks, NOW).first()
    assert (row["total_runs"], row["successful_runs"]) == (3, 2)
    assert round(row["success_rate_percent"], 2) == 66.67
    assert (row["mttr_seconds"], row["freshness_lag_seconds_max"], row["window_hours"]) == (600, 3600, 168)


def test_ops_without_rows(spark):
    row = ops_summary(runs(spark), checkpoints(spark), batches(spark), NOW).first()
    assert row["success_rate_percent"] == 100.0
    zeros = ("total_runs", "successful_runs", "failed_runs", "running_runs", "mttr_seconds", "freshness_lag_seconds_max")
    assert [row[name] for name in (*zeros, "pending_push_batches")] == [0] * 7


def test_ops_health_and_details(spark):
    ledger = runs(
        spark,
        ("first-try", "orders-feed", "FAILED", ago(hours=4), ago(hours=4) + timedelta(minutes=1), 0, 0, "OSError", "disk is full"),
        ("second-try", "orders-feed", "SUCCESS", ago(hours=1), ago(hours=1) + timedelta(seconds=90.9), 3, 1),
    )
    marks = checkpoints(spark, ("orders-feed", "w", ago(hours=2)), ("marked-only", None, ago(hours=3)))
    queue = batches(spark, ("b", "orders-feed", "PENDING", NOW), ("b2", "queue-only", "PENDING", NOW), ("b3", "z", "PROCESSED", NOW))
    known = catalog(spark, ("orders-feed", "p", "rest_push", None, "http"), ("idle", "q", "sql_pull", "s", "oracle"))
    health = connector_health(known, ledger, marks, queue, NOW)
    rows = {r["connector_id"]: r for r in health.collect()}
    assert set(rows) == {"orders-feed", "idle", "marked-only", "queue-only"}
    row = rows["orders-feed"]
    assert (row["last_run_id"], row["last_status"], row["freshness_lag_seconds"], row["pending_push_batches"]) == (
        "second-try", "SUCCESS", 7200, 1
    )
    assert (rows["idle"]["last_run_id"], rows["idle"]["pending_push_batches"]) == (None, 0)
    detail = connector_detail(health, ledger, "orders-feed", status="failed")
    assert [r["run_id"] for r in detail["recent_runs"].collect()] == ["first-try"]
    assert detail["runs_page"].first()["total_runs"] == 1
    one = run_detail(ledger, "first-try", "https://logs/{run_id}", " ").first()
    assert (one["error_message"], one["duration_seconds"], one["log_url"], one["flow_url"]) == (
        "disk is full", 60, "https://logs/first-try", None
    )
    assert run_rows(ledger).where("run_id = 'second-try'").first()["duration_seconds"] == 90
    assert checkpoint_of(marks, "orders-feed") == "w" and checkpoint_of(marks, "nobody") is None
    for lookup in (lambda: run_detail(ledger, "nothing"), lambda: connector_detail(health, ledger, "nothing")):
        with pytest.raises(NotFound):
            lookup()


def test_paging_and_filters(spark):
    ledger = runs(
        spark,
        ("w1", "orders-feed", "FAILED", ago(hours=1), None),
        ("w2", "orders-feed", "FAILED", ago(hours=2), None),
        ("w3", "orders-feed", "SUCCESS", ago(hours=3), None),
        ("w4", "other", "FAILED", ago(hours=1), None),
        ("w5", "orders-feed", "FAILED", ago(hours=900), None),
    )
    none = (catalog(spark), ledger, checkpoints(spark), batches(spark))
    for offset, expected, more in ((0, ["w1"], True), (1, ["w2"], False), (5, [], False)):
        parts = ops_snapshot(*none, NOW, limit=1, offset=offset, status=" failed ", connector_id="orders-feed")
        assert [r["run_id"] for r in parts["recent_runs"].collect()] == expected
        info = parts["runs_page"].first()
        assert (info["total_runs"], info["has_more"]) == (2, more)
        assert [r["connector_id"] for r in parts["connectors"].collect()] == ["orders-feed"]
        assert parts["summary"].first()["total_runs"] == 4
    assert [r["run_id"] for r in runs_page(ledger, 2).collect()] == ["w4", "w1"]
    assert runs_page(ledger, 0, -5).count() == 1
    assert page_info(ledger, 5).first()["has_more"] is False
    with pytest.raises(UnknownStatus):
        filter_runs(ledger, status="done")
    assert runs_page(ledger, 10**6, 200_000).count() == 0 and runs_page(ledger, 10**6).count() == 5
    report = spark.createDataFrame([(str(i), f"c{i}") for i in range(9)], "path string, connector_id string")
    for limit, offset, more in ((4, 4, True), (5, 4, False), (0, -1, True)):
        info = catalog_page_info(report, limit, offset).first()
        assert (info["total_connectors"], info["has_more"]) == (9, more)
    assert catalog_page(report, 5, 4).count() == 5
    with pytest.raises(ValueError):
        ops_snapshot(*none, NOW, hours=721)


def recoveries_by_hand(rows):
    found = {}
    for run_id, connector, status, start, end in rows:
        if status != "FAILED" or end is None:
            continue
        later = [r for r in rows if r[1] == connector and (r[3], r[0]) > (start, run_id) and r[2] == "SUCCESS"]
        found[run_id] = min(later, key=lambda r: (r[3], r[0]))[3] if later else None
    return found


@pytest.mark.parametrize("slice_seconds", [60, 3600, 10**9])
def test_next_success_agrees_with_a_plain_search(spark, slice_seconds):
    rng = random.Random(slice_seconds)
    rows = []
    for number in range(500):
        start = ago(minutes=rng.randint(0, 3000))
        status = rng.choice(["FAILED", "FAILED", "SUCCESS", "RUNNING"])
        end = None if status == "RUNNING" or rng.random() < 0.1 else start + timedelta(seconds=rng.randint(0, 9000))
        rows.append((f"r{number:03}", rng.choice(["hot"] * 5 + ["a", "b", "c"]), status, start, end))
    found = next_success(runs(spark, *rows), slice_seconds)
    mine = {
        r["run_id"]: None if r["s"] is None else datetime.fromtimestamp(r["s"], timezone.utc)
        for r in found.select("run_id", F.unix_seconds("recovered_at").alias("s")).collect()
    }
    expected = recoveries_by_hand(rows)
    assert mine == expected
    ends = {r[0]: r[4] for r in rows}
    gaps = [int((at - ends[k]).total_seconds()) for k, at in expected.items() if at]
    row = mttr_seconds(runs(spark, *rows), slice_seconds=slice_seconds).first()
    assert (row["mttr_seconds"], row["recoveries"]) == (int(sum(gaps) / len(gaps)), len(gaps))


def test_negative_recovery_gap(spark):
    ledger = runs(spark, ("a", "c", "FAILED", ago(hours=3), ago(hours=1)), ("b", "c", "SUCCESS", ago(hours=2), ago(hours=1)))
    assert mttr_seconds(ledger, NOW).first()["mttr_seconds"] == -3600


@pytest.mark.parametrize("span", [1, 7, 3600])
def test_percentile_agrees_with_numpy(spark, span):
    rng = random.Random(span)
    groups = {"ties": [5] * 300 + [9] * 2, "one": [-4], "two": [1, 2], "wide": [rng.randint(-(10**6), 10**6) for _ in range(400)]}
    rows = [(k, v) for k, items in groups.items() for v in items] + [("one", None)]
    found = exact_percentile(spark.createDataFrame(rows, "g string, v bigint"), ["g"], "v", 0.95, "p", "m", span)
    for row in found.collect():
        assert row["p"] == pytest.approx(np.percentile(groups[row["g"]], 95), abs=1e-9)
        assert row["m"] == pytest.approx(np.mean(groups[row["g"]]))
        assert row["rows"] == len(groups[row["g"]])
    assert found.count() == len(groups)


def test_catalog_report(spark):
    known = catalog(
        spark,
        ("hr", "a.yaml", "sql_pull", "spec s", "postgres"),
        ("kb", "b.yaml", "rest_pull", "spec k", "http"),
        ("push", "c.yaml", None, None, "http"),
    )
    jobs = spark.createDataFrame(
        [
            (0, "x", "connectors/hr.yaml", "by path", False),
            (1, "hr", None, "by name", True),
            (2, "kb", "connectors/kb.yaml", "", True),
            (3, "kb", None, "later", True),
        ],
        "position int, name string, connector_path string, schedule string, enabled boolean",
    )
    ledger = runs(spark, ("r1", "hr", "SUCCESS", ago(hours=2)), ("r2", "hr", "FAILED", ago(hours=1)))
    report = catalog_report(known, jobs, ledger)
    rows = {r["connector_id"]: r for r in report.collect()}
    assert (rows["hr"]["schedule"], rows["hr"]["schedule_enabled"], rows["hr"]["last_status"]) == ("by path", False, "FAILED")
    assert (rows["kb"]["schedule"], rows["kb"]["schedule_enabled"]) == ("spec k", True)
    assert (rows["push"]["mode"], rows["push"]["schedule"], rows["push"]["schedule_enabled"]) == ("", None, True)
    assert [r["connector_id"] for r in catalog_page(report, 1, 1).collect()] == ["kb"]
    assert catalog_report(known, jobs, ledger, status="failed", mode="sql_pull", q="H").count() == 1
    assert catalog_report(known, jobs, ledger, mode="SQL_PULL").count() == 0


def test_gates(spark):
    slo = spark.createDataFrame(
        [(99.5, 1200, 300), (80.0, 99999, 99999), (99.0, 10800, 1800)],
        "success_rate_percent double, freshness_lag_seconds_max bigint, mttr_seconds bigint",
    )
    verdicts = {r["success_rate_percent"]: (r["passed"], r["errors"]) for r in slo_gate(slo).collect()}
    assert verdicts[99.5] == (True, []) and verdicts[99.0] == (True, [])
    assert verdicts[80.0][0] is False and len(verdicts[80.0][1]) == 3
    assert verdicts[80.0][1][0] == "success_rate_percent below threshold (80.00 < 99.00)"
    canary = spark.createDataFrame(
        [(0.05, 0.0, False), (0.5, 0.2, True), (0.2, 0.0, False)],
        "error_budget_burn double, failed_run_rate_delta double, freshness_lag_breach boolean",
    )
    verdicts = {r["error_budget_burn"]: (r["passed"], len(r["errors"])) for r in canary_gate(canary).collect()}
    assert verdicts == {0.05: (True, 0), 0.5: (False, 3), 0.2: (False, 1)}
    assert len(canary_gate(canary, allow_stale=True).where("error_budget_burn = 0.5").first()["errors"]) == 2


def test_checks(spark):
    results = spark.createDataFrame(
        [("a", True, True), ("b", False, True), ("c", False, False), ("d", False, False)], "id string, passed boolean, critical boolean"
    )
    baseline = spark.createDataFrame([("b", True), ("c", False)], "id string, passed boolean")
    assert {r["id"] for r in regressions(results, baseline).collect()} == {"b", "d"}
    row = pass_rates(results).first()
    assert (row["pass_rate_percent"], row["critical_pass_rate_percent"], row["ok"]) == (25.0, 50.0, False)
    assert pass_rates(results.where("false")).first()["ok"] is True
    actual = spark.createDataFrame([("connectors/a.yaml",), ("connectors/b.yaml",)], "item string")
    lines = ["# note", "", "./connectors/a.yaml", "connectors\\a.yaml", "connectors/gone.yaml", "other/x.yaml", "other/x.yaml"]
    declared = spark.createDataFrame([(line,) for line in lines], "item string")
    assert {tuple(r) for r in reconcile(actual, declared, r"connectors/[^/]+\.yaml").collect()} == {
        ("missing", "connectors/b.yaml"),
        ("stale", "connectors/gone.yaml"),
        ("duplicate", "connectors/a.yaml"),
        ("malformed", "other/x.yaml"),
    }


def test_dashboard(spark):
    ledger = runs(
        spark,
        ("r1", "hr", "FAILED", ago(minutes=10), ago(minutes=9), 0, 0, "E", "m"),
        ("r2", "hr", "FAILED", ago(minutes=20), ago(minutes=9), 0, 0, "E", "m"),
        ("r3", "kb", "SUCCESS", ago(minutes=70), ago(minutes=60), 4, 1),
        ("r4", "kb", "RUNNING", ago(minutes=1), None),
    )
    chart = status_timechart(ledger, "started_at")
    assert {(r["status"], r["runs"]) for r in chart.collect()} == {("FAILED", 2), ("SUCCESS", 1), ("RUNNING", 1)}
    assert [tuple(r) for r in top_failing(ledger).collect()] == [("hr", "E", 2)]
    events = {r["run_id"]: r for r in run_event(ledger.withColumn("manifest_path", F.lit("m"))).collect()}
    assert set(events) == {"r1", "r2", "r3"}
    assert (events["r3"]["upserts"], events["r3"]["error_class"], events["r1"]["manifest_path"]) == (4, None, None)
    assert duration_stats(ledger).where("connector_id = 'kb'").first()["avg_seconds"] == 600.0
