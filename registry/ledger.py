"""Run ledger, checkpoints, catalog and dashboards over ``events``, ``customer`` and ``supplier``."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.bindings import (
    NOW,
    SQL_BATCHES,
    SQL_CATALOG,
    SQL_CHECKPOINTS,
    SQL_RUNS,
    batches,
    checkpoints,
    runs,
    spec_documents,
    table,
)
from snapdelta.operators.dashboard import (
    duration_stats,
    freshness_stats,
    run_event,
    run_sketches,
    sketched_durations,
    sketched_freshness,
    status_timechart,
    top_failing,
)
from snapdelta.operators.gates import canary_gate, slo_gate
from snapdelta.operators.ledger import (
    catalog_page,
    catalog_report,
    connector_detail,
    connector_health,
    connector_ids,
    filter_runs,
    freshness_lag,
    latest_run,
    mttr_seconds,
    next_success,
    ops_snapshot,
    ops_summary,
    page_info,
    pending_batches,
    run_detail,
    run_rows,
    runs_page,
    slo_metrics,
    status_counts,
)
from snapdelta.operators.ranges import Order, page
from snapdelta.operators.state import advance_checkpoint, advance_checkpoints, fold_run_state
from snapdelta.session import settled
from snapdelta.sources.catalog import catalog

WINDOW = 24 * 15
LOGS, FLOWS = "https://logs/?run={run_id}&full=1", "https://flows"
_TIME = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def shown(df, *times):
    """Timestamps as text, for comparing."""
    return df.withColumns({name: F.date_format(name, _TIME) for name in times})


def _catalog(spark, d):
    return catalog(spec_documents(spark, d))


def _jobs(spark, d):
    """Schedule jobs, one per supplier: by name, by path, some disabled, many shadowed."""
    supplier = table(spark, d, "supplier")
    number = (F.col("s_suppkey") * 7 % 25).cast("string")
    return supplier.select(
        F.col("s_suppkey").alias("position"),
        F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("c"), number)).otherwise("other").alias("name"),
        F.when(F.col("s_suppkey") % 4 != 0, F.concat(F.lit("connectors/c"), number, F.lit(".yaml")))
        .otherwise("elsewhere.yaml")
        .alias("connector_path"),
        F.when(F.col("s_suppkey") % 5 != 0, F.concat(F.lit("job "), "s_suppkey")).alias("schedule"),
        (F.col("s_suppkey") % 2 == 0).alias("enabled"),
    )


def _run_events(spark, d):
    """Two events per run: the start, and the end with its counts unless the run still goes on."""
    ledger = runs(spark, d)
    start = ledger.select(
        "run_id",
        "connector_id",
        F.lit(0).alias("seq"),
        F.lit("RUNNING").alias("status"),
        "started_at",
        F.lit(None).cast("timestamp").alias("finished_at"),
        *[F.lit(None).cast("bigint").alias(name) for name in ("upserts_count", "deletes_count")],
        *[F.lit(None).cast("string").alias(name) for name in ("error_class", "error_message")],
    )
    end = ledger.where("status <> 'RUNNING'").withColumn("seq", F.lit(1)).select(*start.columns)
    return start.unionByName(end)


def _health(spark, d):
    return connector_health(_catalog(spark, d), runs(spark, d), checkpoints(spark, d), batches(spark, d), NOW)


def _canary(spark, d):
    """Canary metrics per connector, from the ledger."""
    by = runs(spark, d).groupBy("connector_id").agg(
        F.count_if(F.col("status") == "FAILED").alias("failed"), F.count(F.lit(1)).alias("total")
    )
    share = F.col("failed") / F.col("total")
    metrics = by.select(
        "connector_id",
        share.alias("error_budget_burn"),
        (share - 0.2).alias("failed_run_rate_delta"),
        (F.col("failed") % 2 == 0).alias("freshness_lag_breach"),
    )
    return canary_gate(metrics).select(
        "connector_id", F.concat_ws("; ", "errors").alias("errors"), "passed"
    )


def _gate(spark, d):
    gated = slo_gate(slo_metrics(runs(spark, d), checkpoints(spark, d), NOW, WINDOW))
    return gated.select(F.concat_ws("; ", "errors").alias("errors"), "passed")


def _advance(spark, d):
    marks = latest_run(runs(spark, d)).select("connector_id", F.col("run_id").alias("watermark"))
    moved = advance_checkpoints(checkpoints(spark, d), marks.where("connector_id < 'c15'"), NOW)
    return shown(advance_checkpoint(moved, "c3", "fixed", "2024-02-02"), "updated_at")


def _timechart(spark, d):
    chart = status_timechart(runs(spark, d), "started_at")
    return shown(chart, "span_start")


def _snapshot_runs(spark, d):
    parts = ops_snapshot(
        _catalog(spark, d), runs(spark, d), checkpoints(spark, d), batches(spark, d), NOW, WINDOW, 40, 5, " failed ", "c4"
    )
    return parts["recent_runs"].select("run_id", "connector_id", "status", "duration_seconds")


def _snapshot_connectors(spark, d):
    parts = ops_snapshot(
        _catalog(spark, d), runs(spark, d), checkpoints(spark, d), batches(spark, d), NOW, WINDOW, status="SUCCESS"
    )
    return parts["connectors"].select("connector_id", "last_status", "pending_push_batches")


def _sketched(exact, sketched, name):
    """The exact percentile, and whether it lies within the bounds of the sketch."""
    held = F.col(name).between(F.col(f"{name}_least"), F.col(f"{name}_most"))
    return exact.select("connector_id", name).join(sketched.drop(name), "connector_id").select("connector_id", "rows", name, held.alias("held"))


def sketched_p95(spark, d):
    """Exact percentiles of freshness and duration, and those of sketches by connector and hour, merged by connector."""
    found = settled(run_sketches(runs(spark, d)), "sketches")
    lags = _sketched(freshness_stats(runs(spark, d), NOW), sketched_freshness(found, NOW), "p95_lag_seconds")
    times = _sketched(duration_stats(runs(spark, d)), sketched_durations(found), "p95_seconds")
    return lags.withColumnRenamed("held", "lag_held").join(times.select("connector_id", "p95_seconds", F.col("held").alias("duration_held")), "connector_id")


def deep_page(spark, d):
    """A page that begins behind half of all runs, found by ranges of the order."""
    found = runs(spark, d)
    order = [Order("started_at", falls=True), Order("run_id", falls=True)]
    return page(found, order, found.count() // 2, 100, range_rows=2_000).select("run_id", "connector_id", "status")


def _detail(spark, d):
    """The page of runs, with what the page info and the health row say beside it."""
    parts = connector_detail(_health(spark, d), runs(spark, d), "c5", "failed", 30, 10)
    info = parts["runs_page"].first()
    health = parts["connector"].first()
    beside = {"total_runs": info["total_runs"], "has_more": info["has_more"], "last_status": health["last_status"], "waiting": health["pending_push_batches"]}
    kinds = {"total_runs": "bigint", "has_more": "boolean", "last_status": "string", "waiting": "bigint"}
    rows = parts["recent_runs"].select("run_id", "status", "error_class", "duration_seconds")
    return rows.withColumns({name: F.lit(value).cast(kinds[name]) for name, value in beside.items()})


QUERIES = {
    "connector_catalog": _catalog,
    "run_rows": lambda spark, d: shown(run_rows(runs(spark, d), LOGS, FLOWS), "started_at", "finished_at"),
    "filter_runs": lambda spark, d: filter_runs(runs(spark, d), NOW, WINDOW, "c2", " success").select(
        "run_id", "connector_id", "status"
    ),
    "latest_run": lambda spark, d: shown(latest_run(runs(spark, d)), "started_at", "finished_at"),
    "next_success": lambda spark, d: shown(next_success(runs(spark, d)), "finished_at", "recovered_at"),
    "mttr": lambda spark, d: mttr_seconds(runs(spark, d), NOW, WINDOW),
    "mttr_by_connector": lambda spark, d: mttr_seconds(runs(spark, d), by_connector=True),
    "freshness_lag": lambda spark, d: freshness_lag(checkpoints(spark, d), NOW),
    "status_counts": lambda spark, d: status_counts(runs(spark, d), NOW, WINDOW),
    "slo_metrics": lambda spark, d: slo_metrics(runs(spark, d), checkpoints(spark, d), NOW, WINDOW),
    "slo_gate": _gate,
    "canary_gate": _canary,
    "ops_summary": lambda spark, d: ops_summary(
        runs(spark, d), checkpoints(spark, d), batches(spark, d), NOW, WINDOW
    ).drop("generated_at"),
    "ops_snapshot_runs": _snapshot_runs,
    "ops_snapshot_connectors": _snapshot_connectors,
    "pending_batches": lambda spark, d: pending_batches(batches(spark, d)),
    "pending_batches_by_connector": lambda spark, d: pending_batches(batches(spark, d), by_connector=True),
    "connector_ids": lambda spark, d: connector_ids(
        _catalog(spark, d), runs(spark, d), checkpoints(spark, d), batches(spark, d)
    ),
    "connector_health": lambda spark, d: shown(
        _health(spark, d), "last_started_at", "last_finished_at", "checkpoint_updated_at"
    ),
    "connector_detail": _detail,
    "run_detail": lambda spark, d: run_detail(runs(spark, d), "100", LOGS, FLOWS).select(
        "run_id", "connector_id", "status", "duration_seconds", "error_message", "log_url", "flow_url"
    ),
    "runs_page": lambda spark, d: runs_page(runs(spark, d), 100, 250).select("run_id", "connector_id", "status"),
    "runs_page_deep": deep_page,
    "page_info": lambda spark, d: page_info(runs(spark, d), 100, 250),
    "catalog_report": lambda spark, d: shown(
        catalog_report(_catalog(spark, d), _jobs(spark, d), runs(spark, d)), "last_started_at"
    ),
    "catalog_filter": lambda spark, d: catalog_report(
        _catalog(spark, d), _jobs(spark, d), runs(spark, d), "success", "rest_push", "C1"
    ).select("connector_id", "mode", "last_status"),
    "catalog_page": lambda spark, d: catalog_page(
        catalog_report(_catalog(spark, d), _jobs(spark, d), runs(spark, d)), 5, 3
    ).select("path", "connector_id"),
    "advance_checkpoint": _advance,
    "fold_run_state": lambda spark, d: shown(fold_run_state(_run_events(spark, d)), "started_at", "finished_at"),
    "run_event": lambda spark, d: run_event(
        runs(spark, d).withColumn("manifest_path", F.concat(F.lit("runs/"), "run_id"))
    ),
    "status_timechart": _timechart,
    "top_failing": lambda spark, d: top_failing(runs(spark, d)),
    "freshness_stats": lambda spark, d: freshness_stats(runs(spark, d), NOW),
    "duration_stats": lambda spark, d: duration_stats(runs(spark, d)),
    "sketched_p95": sketched_p95,
}

_WINDOW_START = f"TIMESTAMP '2024-02-01 00:00:00' - INTERVAL {WINDOW} HOUR"
_NOW = "TIMESTAMP '2024-02-01 00:00:00'"


def _text(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f') AS {column.split('.')[-1]}"


def _seconds(later: str, earlier: str) -> str:
    return f"((epoch_us({later}) - epoch_us({earlier})) / 1000000.0)"


def _gaps(source: str) -> str:
    """Recovery of each finished failure, by the plain rule: first success in start order after it."""
    return f"""ranked AS (SELECT *, first_value(CASE WHEN status = 'SUCCESS' THEN started_at END IGNORE NULLS) OVER (
          PARTITION BY connector_id ORDER BY started_at, run_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
          AS recovered_at FROM {source}),
        failures AS (SELECT connector_id, run_id, finished_at, recovered_at,
          trunc({_seconds('recovered_at', 'finished_at')})::BIGINT AS gap FROM ranked
          WHERE status = 'FAILED' AND finished_at IS NOT NULL)"""


_LEDGER = f"WITH {SQL_RUNS}, {SQL_CHECKPOINTS}, {SQL_BATCHES}, {SQL_CATALOG}"
_WINDOWED = f"windowed AS (SELECT * FROM runs WHERE started_at >= {_WINDOW_START})"
_LAG = f"(SELECT coalesce(max(trunc({_seconds(_NOW, 'updated_at')})::BIGINT), 0) FROM checkpoints)"
_MTTR = "(SELECT coalesce(trunc(avg(gap))::BIGINT, 0) FROM failures WHERE gap IS NOT NULL)"
_SLO = f"""{_LEDGER}, {_WINDOWED}, {_gaps('windowed')},
  slo AS (SELECT {WINDOW} AS window_hours, count(*) AS total_runs, count(*) FILTER (status = 'SUCCESS') AS successful_runs,
          count(*) FILTER (status = 'FAILED') AS failed_runs, count(*) FILTER (status = 'RUNNING') AS running_runs,
          CASE WHEN count(*) > 0 THEN count(*) FILTER (status = 'SUCCESS') / count(*) * 100 ELSE 100.0 END
            AS success_rate_percent,
          {_MTTR} AS mttr_seconds, {_LAG} AS freshness_lag_seconds_max,
          (SELECT count(*) FROM batches WHERE status = 'PENDING') AS pending_push_batches FROM windowed)"""
_LATEST = """latest AS (SELECT * FROM runs QUALIFY row_number() OVER (
    PARTITION BY connector_id ORDER BY started_at DESC, run_id DESC) = 1)"""
_IDS = """ids AS (SELECT connector_id FROM catalog UNION SELECT connector_id FROM runs UNION
    SELECT connector_id FROM checkpoints UNION SELECT connector_id FROM batches WHERE status = 'PENDING')"""
_WAITING = """waiting AS (SELECT connector_id, count(*) AS n FROM batches WHERE status = 'PENDING' GROUP BY 1)"""
_JOBS = """jobs AS (SELECT s_suppkey AS position,
    CASE WHEN s_suppkey % 3 = 0 THEN 'c' || (s_suppkey * 7 % 25) ELSE 'other' END AS name,
    CASE WHEN s_suppkey % 4 <> 0 THEN 'connectors/c' || (s_suppkey * 7 % 25) || '.yaml' ELSE 'elsewhere.yaml' END
      AS connector_path,
    CASE WHEN s_suppkey % 5 <> 0 THEN 'job ' || s_suppkey END AS schedule, s_suppkey % 2 = 0 AS enabled
  FROM supplier)"""
_REPORT = f"""{_LEDGER}, {_LATEST}, {_JOBS},
  matched AS (SELECT c.connector_id, arg_min(struct_pack(s := j.schedule, e := j.enabled), j.position) AS job
    FROM catalog c JOIN jobs j ON j.name = c.connector_id OR j.connector_path = 'connectors/' || c.connector_id || '.yaml'
    GROUP BY 1),
  report AS (SELECT c.path, c.connector_id, c.mode, coalesce(m.job.s, c.schedule) AS schedule,
      coalesce(m.job.e, true) AS schedule_enabled, c.source_type, l.status AS last_status, l.run_id AS last_run_id,
      l.started_at AS last_started_at
    FROM catalog c LEFT JOIN matched m USING (connector_id) LEFT JOIN latest l USING (connector_id))"""

ORACLES = {
    "connector_catalog": f"{_LEDGER} SELECT connector_id, path, mode, schedule, source_type FROM catalog",
    "run_rows": f"""WITH {SQL_RUNS} SELECT run_id, connector_id, status, {_text('started_at')}, {_text('finished_at')},
        trunc({_seconds('runs.finished_at', 'runs.started_at')})::BIGINT AS duration_seconds, upserts_count,
        deletes_count, error_class, 'https://logs/?run=' || run_id || '&full=1' AS log_url,
        'https://flows/' || run_id AS flow_url FROM runs""",
    "filter_runs": f"""WITH {SQL_RUNS} SELECT run_id, connector_id, status FROM runs
        WHERE started_at >= {_WINDOW_START} AND connector_id = 'c2' AND status = 'SUCCESS'""",
    "latest_run": f"""WITH {SQL_RUNS}, {_LATEST} SELECT connector_id, run_id, status, {_text('started_at')},
        {_text('finished_at')}, upserts_count, deletes_count, error_class, error_message FROM latest""",
    "next_success": f"""WITH {SQL_RUNS}, {_gaps('runs')} SELECT connector_id, run_id, {_text('finished_at')},
        {_text('recovered_at')} FROM failures""",
    "mttr": f"""WITH {SQL_RUNS}, {_WINDOWED}, {_gaps('windowed')} SELECT {_MTTR} AS mttr_seconds,
        count(gap) AS recoveries FROM failures""",
    "mttr_by_connector": f"""WITH {SQL_RUNS}, {_gaps('runs')} SELECT connector_id,
        trunc(avg(gap))::BIGINT AS mttr_seconds, count(gap) AS recoveries FROM failures WHERE gap IS NOT NULL GROUP BY 1""",
    "freshness_lag": f"WITH {SQL_RUNS}, {SQL_CHECKPOINTS} SELECT {_LAG} AS freshness_lag_seconds_max",
    "status_counts": f"{_SLO} SELECT total_runs, successful_runs, failed_runs, running_runs FROM slo",
    "slo_metrics": f"""{_SLO} SELECT window_hours, total_runs, successful_runs, success_rate_percent, mttr_seconds,
        freshness_lag_seconds_max FROM slo""",
    "slo_gate": f"""{_SLO}, checked AS (SELECT array_to_string(list_filter([
          CASE WHEN success_rate_percent < 99.0
            THEN printf('success_rate_percent below threshold (%.2f < 99.00)', success_rate_percent) END,
          CASE WHEN freshness_lag_seconds_max > 10800
            THEN printf('freshness_lag_seconds_max above threshold (%d > 10800)', freshness_lag_seconds_max) END,
          CASE WHEN mttr_seconds > 1800 THEN printf('mttr_seconds above threshold (%d > 1800)', mttr_seconds) END],
          lambda x: x IS NOT NULL), '; ') AS errors FROM slo) SELECT errors, errors = '' AS passed FROM checked""",
    "canary_gate": f"""WITH {SQL_RUNS}, shares AS (SELECT connector_id, count(*) FILTER (status = 'FAILED') AS failed,
          count(*) FILTER (status = 'FAILED') / count(*) AS share FROM runs GROUP BY 1),
        checked AS (SELECT connector_id, array_to_string(list_filter([
          CASE WHEN share >= 0.2 THEN printf('error_budget_burn exceeded threshold (%.4f >= 0.2000)', share) END,
          CASE WHEN share - 0.2::DOUBLE > 0
            THEN printf('failed_run_rate_delta exceeded threshold (%.4f > 0.0000)', share - 0.2::DOUBLE) END,
          CASE WHEN failed % 2 = 0 THEN 'freshness lag breach detected' END], lambda x: x IS NOT NULL), '; ') AS errors
          FROM shares) SELECT connector_id, errors, errors = '' AS passed FROM checked""",
    "ops_summary": f"""{_SLO} SELECT window_hours, total_runs, successful_runs, failed_runs, running_runs,
        success_rate_percent, mttr_seconds, freshness_lag_seconds_max, pending_push_batches FROM slo""",
    "ops_snapshot_runs": f"""WITH {SQL_RUNS} SELECT run_id, connector_id, status,
        trunc({_seconds('finished_at', 'started_at')})::BIGINT AS duration_seconds FROM runs
        WHERE started_at >= {_WINDOW_START} AND connector_id = 'c4' AND status = 'FAILED'
        ORDER BY started_at DESC, run_id DESC LIMIT 40 OFFSET 5""",
    "ops_snapshot_connectors": f"""{_LEDGER}, {_LATEST}, {_IDS}, {_WAITING}
        SELECT connector_id, l.status AS last_status, coalesce(w.n, 0) AS pending_push_batches
        FROM ids LEFT JOIN latest l USING (connector_id) LEFT JOIN waiting w USING (connector_id)
        WHERE l.status = 'SUCCESS'""",
    "pending_batches": f"""WITH {SQL_BATCHES} SELECT count(*) AS pending_push_batches FROM batches
        WHERE status = 'PENDING'""",
    "pending_batches_by_connector": f"""WITH {SQL_BATCHES}, {_WAITING}
        SELECT connector_id, n AS pending_push_batches FROM waiting""",
    "connector_ids": f"{_LEDGER}, {_IDS} SELECT connector_id FROM ids",
    "connector_health": f"""{_LEDGER}, {_LATEST}, {_IDS}, {_WAITING}, joined AS (
        SELECT connector_id, c.mode, c.schedule, c.source_type, l.run_id AS last_run_id, l.status AS last_status,
          l.started_at AS last_started_at, l.finished_at AS last_finished_at, l.error_class AS last_error_class,
          k.watermark AS checkpoint_watermark, k.updated_at AS checkpoint_updated_at,
          trunc({_seconds(_NOW, 'k.updated_at')})::BIGINT AS freshness_lag_seconds,
          coalesce(w.n, 0) AS pending_push_batches
        FROM ids LEFT JOIN catalog c USING (connector_id) LEFT JOIN latest l USING (connector_id)
          LEFT JOIN checkpoints k USING (connector_id) LEFT JOIN waiting w USING (connector_id))
        SELECT * REPLACE (strftime(last_started_at, '%Y-%m-%d %H:%M:%S.%f') AS last_started_at,
          strftime(last_finished_at, '%Y-%m-%d %H:%M:%S.%f') AS last_finished_at,
          strftime(checkpoint_updated_at, '%Y-%m-%d %H:%M:%S.%f') AS checkpoint_updated_at) FROM joined""",
    "connector_detail": f"""WITH {SQL_RUNS}, {SQL_BATCHES},
        failed AS (SELECT count(*) AS n FROM runs WHERE connector_id = 'c5' AND status = 'FAILED')
        SELECT run_id, status, error_class, trunc({_seconds('finished_at', 'started_at')})::BIGINT AS duration_seconds,
          (SELECT n FROM failed) AS total_runs, (SELECT n > 40 FROM failed) AS has_more,
          (SELECT status FROM runs WHERE connector_id = 'c5' ORDER BY started_at DESC, run_id DESC LIMIT 1) AS last_status,
          (SELECT count(*) FROM batches WHERE connector_id = 'c5' AND status = 'PENDING') AS waiting
        FROM runs WHERE connector_id = 'c5' AND status = 'FAILED' ORDER BY started_at DESC, run_id DESC LIMIT 30 OFFSET 10""",
    "run_detail": f"""WITH {SQL_RUNS} SELECT run_id, connector_id, status,
        trunc({_seconds('finished_at', 'started_at')})::BIGINT AS duration_seconds, error_message,
        'https://logs/?run=' || run_id || '&full=1' AS log_url, 'https://flows/' || run_id AS flow_url
        FROM runs WHERE run_id = '100'""",
    "runs_page": f"""WITH {SQL_RUNS} SELECT run_id, connector_id, status FROM runs
        ORDER BY started_at DESC, run_id DESC LIMIT 100 OFFSET 250""",
    "runs_page_deep": f"""WITH {SQL_RUNS} SELECT run_id, connector_id, status FROM runs
        ORDER BY started_at DESC, run_id DESC LIMIT 100 OFFSET (SELECT count(*) // 2 FROM events)""",
    "page_info": """SELECT 100 AS limit_runs, 250 AS offset_runs, count(*) AS total_runs, 350 < count(*) AS has_more
        FROM events""",
    "catalog_report": f"""{_REPORT} SELECT * REPLACE (strftime(last_started_at, '%Y-%m-%d %H:%M:%S.%f')
        AS last_started_at) FROM report""",
    "catalog_filter": f"""{_REPORT} SELECT connector_id, mode, last_status FROM report
        WHERE last_status = 'SUCCESS' AND mode = 'rest_push' AND contains(connector_id, 'c1')""",
    "catalog_page": f"{_REPORT} SELECT path, connector_id FROM report ORDER BY path LIMIT 5 OFFSET 3",
    "advance_checkpoint": f"""WITH {SQL_RUNS}, {SQL_CHECKPOINTS}, {_LATEST}, moved AS (
          SELECT connector_id, run_id AS watermark, {_NOW} AS updated_at FROM latest
          WHERE connector_id < 'c15' AND connector_id <> 'c3'
          UNION ALL SELECT * FROM checkpoints WHERE connector_id >= 'c15' AND connector_id <> 'c3'
          UNION ALL SELECT 'c3', 'fixed', TIMESTAMP '2024-02-02 00:00:00')
        SELECT connector_id, watermark, {_text('updated_at')} FROM moved""",
    "fold_run_state": f"""WITH {SQL_RUNS} SELECT run_id, connector_id, status, {_text('started_at')},
        {_text('finished_at')}, CASE WHEN status = 'RUNNING' THEN 0 ELSE upserts_count END AS upserts_count,
        CASE WHEN status = 'RUNNING' THEN 0 ELSE deletes_count END AS deletes_count, error_class, error_message FROM runs""",
    "run_event": f"""WITH {SQL_RUNS} SELECT status, connector_id, run_id,
        CASE WHEN status = 'SUCCESS' THEN upserts_count END AS upserts,
        CASE WHEN status = 'SUCCESS' THEN deletes_count END AS deletes,
        CASE WHEN status = 'SUCCESS' THEN 'runs/' || run_id END AS manifest_path, error_class, error_message
        FROM runs WHERE status <> 'RUNNING'""",
    "status_timechart": f"""WITH {SQL_RUNS} SELECT strftime(date_trunc('hour', started_at), '%Y-%m-%d %H:%M:%S.%f')
        AS span_start, status, count(*) AS runs FROM runs GROUP BY 1, 2""",
    "top_failing": f"""WITH {SQL_RUNS} SELECT connector_id, error_class, count(*) AS failures FROM runs
        WHERE status = 'FAILED' GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2""",
    "freshness_stats": f"""WITH {SQL_RUNS}, ages AS (SELECT connector_id,
          trunc({_seconds(_NOW, 'finished_at')})::BIGINT AS lag FROM runs WHERE status = 'SUCCESS')
        SELECT connector_id, avg(lag) AS avg_lag_seconds, quantile_cont(lag, 0.95) AS p95_lag_seconds
        FROM ages GROUP BY 1""",
    "duration_stats": f"""WITH {SQL_RUNS}, times AS (SELECT connector_id,
          trunc({_seconds('finished_at', 'started_at')})::BIGINT AS seconds FROM runs WHERE finished_at IS NOT NULL)
        SELECT connector_id, count(*) AS rows, avg(seconds) AS avg_seconds, quantile_cont(seconds, 0.95) AS p95_seconds
        FROM times GROUP BY 1""",
    "sketched_p95": f"""WITH {SQL_RUNS}, ages AS (SELECT connector_id, count(*) AS rows, quantile_cont(lag, 0.95) AS p95_lag_seconds
          FROM (SELECT connector_id, trunc({_seconds(_NOW, 'finished_at')})::BIGINT AS lag FROM runs WHERE status = 'SUCCESS') GROUP BY 1),
        times AS (SELECT connector_id, quantile_cont(seconds, 0.95) AS p95_seconds
          FROM (SELECT connector_id, trunc({_seconds('finished_at', 'started_at')})::BIGINT AS seconds FROM runs
            WHERE finished_at IS NOT NULL) GROUP BY 1)
        SELECT connector_id, rows, p95_lag_seconds, true AS lag_held, p95_seconds, true AS duration_held
        FROM ages JOIN times USING (connector_id)""",
}
assert set(ORACLES) <= set(QUERIES)
