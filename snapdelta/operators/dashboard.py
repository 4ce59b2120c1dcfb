"""Run events as dashboards ask for them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapdelta.functions.text import instant, utc, whole_seconds
from snapdelta.operators.quantile import exact_percentile, merged_sketches, sketched_percentile, sketches


def run_event(runs: DataFrame) -> DataFrame:
    """Log record of each run: counts and manifest of a success, class and message of a failure."""
    ok, failed = F.col("status") == "SUCCESS", F.col("status") == "FAILED"
    return runs.where(ok | failed).select(
        "status",
        "connector_id",
        "run_id",
        F.when(ok, F.col("upserts_count")).alias("upserts"),
        F.when(ok, F.col("deletes_count")).alias("deletes"),
        F.when(ok, F.col("manifest_path")).alias("manifest_path"),
        F.when(failed, F.col("error_class")).alias("error_class"),
        F.when(failed, F.col("error_message")).alias("error_message"),
    )


def status_timechart(run_events: DataFrame, ts: str = "ts", span: str = "1 hour") -> DataFrame:
    """Number of events by time span and status."""
    timed = run_events.select(instant(F.col(ts)).alias("ts"), "status")
    counted = timed.groupBy(F.window("ts", span), "status").agg(F.count(F.lit(1)).alias("runs"))
    return counted.select(F.col("window.start").alias("span_start"), "status", "runs")


def top_failing(run_events: DataFrame) -> DataFrame:
    """Failures by connector and error class, the most frequent first."""
    failed = run_events.where("status = 'FAILED'")
    counted = failed.groupBy("connector_id", "error_class").agg(F.count(F.lit(1)).alias("failures"))
    return counted.orderBy(F.desc("failures"), "connector_id", "error_class")


def freshness_stats(run_events: DataFrame, now: datetime | str) -> DataFrame:
    """Mean and 95th percentile of the age of successful runs, by connector."""
    ages = run_events.where("status = 'SUCCESS' and finished_at is not null").select(
        "connector_id", whole_seconds(utc(now), F.col("finished_at")).alias("lag_seconds")
    )
    found = exact_percentile(ages, ["connector_id"], "lag_seconds", 0.95, "p95_lag_seconds", "avg_lag_seconds")
    return found.select("connector_id", "avg_lag_seconds", "p95_lag_seconds")


def duration_stats(runs: DataFrame) -> DataFrame:
    """Mean and 95th percentile duration of finished runs, by connector."""
    times = runs.where("finished_at is not null").select(
        "connector_id", whole_seconds(F.col("finished_at"), F.col("started_at")).alias("seconds")
    )
    return exact_percentile(times, ["connector_id"], "seconds", 0.95, "p95_seconds", "avg_seconds")


def run_sketches(runs: DataFrame, span: str = "1 hour") -> DataFrame:
    """Sketches of the finished runs' durations and, of successful ones, of their ends: one row per connector and span of the end.

    Rows of later spans are added to those of earlier ones, and any choice of spans can be merged later. Ends are kept and not
    ages, so a sketch does not depend on when it is asked.
    """
    ended = runs.where("finished_at is not null").select(
        "connector_id",
        F.window("finished_at", span)["start"].alias("span_start"),
        whole_seconds(F.col("finished_at"), F.col("started_at")).alias("seconds"),
        F.when(F.col("status") == "SUCCESS", F.unix_seconds("finished_at")).alias("ended_at"),
    )
    keys = ["connector_id", "span_start"]
    durations = sketches(ended, keys, "seconds").withColumn("of", F.lit("duration"))
    ends = sketches(ended, keys, "ended_at").withColumn("of", F.lit("end"))
    return durations.unionByName(ends).select("of", *keys, "rows", "sketch")


def sketched_durations(found: DataFrame, share: float = 0.95) -> DataFrame:
    """Percentile duration by connector out of ``run_sketches``, with the bounds between which the exact one lies."""
    merged = merged_sketches(found.where("of = 'duration'"), ["connector_id"])
    return sketched_percentile(merged, share, "p95_seconds").drop("sketch")


def sketched_freshness(found: DataFrame, now: datetime | str, share: float = 0.95) -> DataFrame:
    """Percentile age of successful runs by connector out of ``run_sketches``: the age of the run that few ended before."""
    merged = merged_sketches(found.where("of = 'end'"), ["connector_id"])
    ends = sketched_percentile(merged, 1 - share, "end")
    until = F.unix_seconds(utc(now))
    ages = {"p95_lag_seconds": "end", "p95_lag_seconds_least": "end_most", "p95_lag_seconds_most": "end_least"}
    return ends.select("connector_id", "rows", *[(until - F.col(end)).alias(name) for name, end in ages.items()])
