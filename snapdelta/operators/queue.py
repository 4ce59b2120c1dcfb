"""Push intake and queue: idempotency, counts, next batch, processed flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check_targets(parsed: DataFrame, catalog: DataFrame) -> DataFrame:
    """Adds ``target_error`` to requests whose connector is unknown or does not take pushes.

    ``catalog`` has one row per connector, so the join adds no rows; its size decides how it runs.
    """
    modes = catalog.select("connector_id", F.coalesce("mode", F.lit("")).alias("_mode"))
    error = F.when(F.col("_mode").isNull(), "unknown connector").when(F.col("_mode") != "rest_push", "not a push connector")
    return parsed.join(modes, "connector_id", "left").select(*parsed.columns, error.alias("target_error"))


def acceptable(parsed: DataFrame) -> Column:
    """Whether a request may take its key: its body is sound, and its connector takes pushes where that was looked at."""
    good = F.col("body_error").isNull()
    return good & F.col("target_error").isNull() if "target_error" in parsed.columns else good


def key_claims(parsed: DataFrame, keys: DataFrame) -> DataFrame:
    """One row per key: its first acceptable request here and its known hash."""
    claim = F.when(acceptable(parsed), F.struct("received_at", "request_id", "request_hash"))
    claims = parsed.where("key <> ''").groupBy("key").agg(F.min(claim).alias("f"))
    known = keys.select("key", F.col("request_hash").alias("known_hash"))
    return claims.join(known, "key", "left").select(
        "key",
        F.col("f.received_at").alias("first_at"),
        F.col("f.request_id").alias("first_id"),
        F.col("f.request_hash").alias("first_hash"),
        "known_hash",
    )


def _with_claims(parsed: DataFrame, claims: DataFrame) -> DataFrame:
    """Requests with the claims of their key, safe against very frequent keys.

    Requests without a key have no claim: they stay where they are and take no part in the join. Keys that repeat often are
    left to the join's skew split, which needs no number of them to be known.
    """
    has_key = F.coalesce(F.col("key") != "", F.lit(False))
    return parsed.where(has_key).join(claims, "key", "left").unionByName(parsed.where(~has_key), allowMissingColumns=True)


def classify_requests(parsed: DataFrame, keys: DataFrame) -> DataFrame:
    """Adds ``outcome`` to parsed requests: original, replay, conflict, invalid, refused or no_key.

    ``keys`` (``key``, ``request_hash``) are keys used before this batch. Inside the batch the first
    parseable request takes the key; the same body again is a replay, another body a conflict.
    Keys count across connectors and never expire. Requests that ``check_targets`` has found fault
    with are refused before their key is looked at.
    """
    return judged(parsed, key_claims(parsed, keys))


def judged(parsed: DataFrame, claims: DataFrame) -> DataFrame:
    """Adds ``outcome`` to requests by the claims of their keys, as ``key_claims`` finds them."""
    refused = F.col("target_error").isNotNull() if "target_error" in parsed.columns else F.lit(False)
    joined = _with_claims(parsed, claims)
    place, first_place = F.struct("received_at", "request_id"), F.struct("first_at", "first_id")
    before = place < first_place
    is_first = F.col("received_at").eqNullSafe(F.col("first_at")) & (F.col("request_id") == F.col("first_id"))
    same = F.col("request_hash") == F.coalesce("known_hash", "first_hash")
    outcome = (
        F.when(F.coalesce(F.col("key") == "", F.lit(True)), "no_key")
        .when(refused, "refused")
        .when(F.col("known_hash").isNotNull(), F.when(same, "replay").otherwise("conflict"))
        .when(F.col("first_hash").isNull() | before, "invalid")
        .when(is_first, "original")
        .when(same, "replay")
        .otherwise("conflict")
    )
    return joined.withColumn("outcome", outcome).drop("known_hash", "first_at", "first_id", "first_hash")


def request_counts(flagged: DataFrame, by: str = "request_id") -> DataFrame:
    """Accepted and rejected events per request."""
    return flagged.groupBy(by).agg(
        F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected")
    )


def next_pending_batch(batches: DataFrame, run_id: str | None = None) -> DataFrame:
    """The oldest waiting batch of every connector, or exactly the named one if it waits."""
    waiting = batches.where("status = 'PENDING'")
    if run_id:
        waiting = waiting.where(F.col("run_id") == run_id)
    fields = [name for name in batches.columns if name != "connector_id"]
    oldest = waiting.groupBy("connector_id").agg(
        F.min_by(F.struct(*fields), F.struct("created_at", "run_id")).alias("b")
    )
    return oldest.select("connector_id", *[F.col(f"b.{name}").alias(name) for name in fields])


def mark_processed(batches: DataFrame, events: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Batches and events with the flags set for the drained batches (``connector_id``, ``run_id``).

    ``done`` has one row per drained batch, so it joins without multiplying rows.
    """
    keys = ["connector_id", "run_id"]
    flags = done.select(*keys, F.lit(True).alias("_done"))
    new_status = F.when(F.col("_done"), "PROCESSED").otherwise(F.col("status"))
    new_flag = F.col("processed") | F.coalesce("_done", F.lit(False))
    marked = batches.join(flags, keys, "left").withColumn("status", new_status).select(*batches.columns)
    consumed = events.join(flags, keys, "left").withColumn("processed", new_flag).select(*events.columns)
    return marked, consumed
