"""Comparing inventories and check results with what was declared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_PASS_RATE = 95.0
MIN_CRITICAL_RATE = 100.0


def clean_path(column: Column) -> Column:
    """A declared path: slashes forward, edges trimmed, a leading ``./`` dropped."""
    return F.regexp_replace(F.btrim(F.replace(column, F.lit("\\"), F.lit("/"))), r"^\./", "")


def reconcile(actual: DataFrame, declared: DataFrame, pattern: str) -> DataFrame:
    """``kind, item``: missing, stale, duplicate and malformed entries.

    Both inputs have one text column ``item``. Blank and comment lines of ``declared`` are skipped,
    entries that do not match the pattern are malformed and declare nothing.
    """
    entries = declared.select(F.btrim("item").alias("item")).where("item <> '' and not startswith(item, '#')")
    cleaned = entries.select("item", clean_path(F.col("item")).alias("path"))
    fits = F.col("path").rlike(f"^(?:{pattern})$")
    malformed = cleaned.where(~fits).groupBy("item").agg(F.lit("malformed").alias("kind"))
    listed = cleaned.where(fits).groupBy(F.col("path").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    present = actual.select("item").distinct().withColumn("here", F.lit(True))
    joined = present.join(listed, "item", "full")
    kinds = F.array(
        F.when(F.col("n").isNull(), "missing"),
        F.when(F.col("here").isNull(), "stale"),
        F.when(F.col("n") > 1, "duplicate"),
    )
    drift = joined.select("item", F.explode(kinds).alias("kind")).where("kind is not null")
    return drift.select("kind", "item").unionByName(malformed.select("kind", "item"))


def regressions(results: DataFrame, baseline: DataFrame) -> DataFrame:
    """Ids that fail now and passed before; an id without a baseline counts as passed before."""
    before = baseline.select("id", F.col("passed").alias("before"))
    return results.where("not passed").join(before, "id", "left").where("coalesce(before, true)").select("id")


def pass_rates(
    results: DataFrame, min_rate: float = MIN_PASS_RATE, min_critical: float = MIN_CRITICAL_RATE
) -> DataFrame:
    """Totals and rates over all and over critical results; no results count as 100 percent."""

    def rate(passed: str, total: str) -> Column:
        return F.when(F.col(total) > 0, F.col(passed) / F.col(total) * 100).otherwise(100.0)

    counted = results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("passed").alias("passed"),
        F.count_if("critical").alias("critical_total"),
        F.count_if(F.col("critical") & F.col("passed")).alias("critical_passed"),
    )
    rated = counted.withColumn("pass_rate_percent", rate("passed", "total")).withColumn(
        "critical_pass_rate_percent", rate("critical_passed", "critical_total")
    )
    good = (F.col("pass_rate_percent") >= min_rate) & (F.col("critical_pass_rate_percent") >= min_critical)
    return rated.withColumn("ok", good)
