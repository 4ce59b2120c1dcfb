"""Merging deltas into keyed tables, and folding small ledgers."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapdelta.functions.text import index_id, utc
from snapdelta.operators.envelope import index_envelope

STATE_SCHEMA = (
    "connector_id string, doc_id string, checksum string, source_updated_at timestamp, last_seen_run_id string"
)


def apply_state(
    state: DataFrame, upserts: DataFrame, deletes: DataFrame, connector_id: str, run_id: str
) -> DataFrame:
    """Record state after a delta: touched keys leave, upserts come back with the new checksum.

    A key that is both upserted and deleted is deleted. Rows of other connectors stay. The delta
    is usually small, so dropping touched keys does not move the state over the network.
    """
    gone = deletes.select("doc_id")
    added = upserts.join(gone, "doc_id", "left_anti").select(
        F.lit(connector_id).alias("connector_id"),
        "doc_id",
        "checksum",
        F.col("updated_at").alias("source_updated_at"),
        F.lit(run_id).alias("last_seen_run_id"),
    )
    touched = upserts.select("doc_id").unionByName(gone).withColumn("connector_id", F.lit(connector_id))
    return state.join(touched, ["connector_id", "doc_id"], "left_anti").unionByName(added)


def apply_delta(target: DataFrame, upserts: DataFrame, deletes: DataFrame) -> DataFrame:
    """Index table after a delta, keyed by the index-safe id; deleting an absent id is no error."""
    gone = deletes.select(index_id(F.col("doc_id")).alias("id"))
    incoming = index_envelope(upserts)
    added = incoming.join(gone, "id", "left_anti")
    touched = incoming.select("id").unionByName(gone)
    return target.join(touched, "id", "left_anti").unionByName(added)


def last_per_document(events: DataFrame, order: str) -> DataFrame:
    """One document per id and operation kind: the last one in the given order."""
    fields = [name for name in events.columns if name not in ("doc_id", "op")]
    latest = events.groupBy("doc_id", "op").agg(F.max_by(F.struct(*fields), order).alias("d"))
    return latest.select("doc_id", "op", "d.*")


def advance_checkpoint(
    checkpoints: DataFrame, connector_id: str, watermark: str | None, now: datetime | str
) -> DataFrame:
    """Checkpoints with the connector's mark set and its time refreshed."""
    moved = checkpoints.sparkSession.range(1).select(
        F.lit(connector_id).alias("connector_id"),
        F.lit(watermark).cast("string").alias("watermark"),
        utc(now).alias("updated_at"),
    )
    return checkpoints.where(F.col("connector_id") != connector_id).unionByName(moved)


def advance_checkpoints(checkpoints: DataFrame, marks: DataFrame, now: datetime | str) -> DataFrame:
    """``advance_checkpoint`` for many connectors at once; ``marks`` is connector and watermark."""
    moved = marks.select("connector_id", "watermark", utc(now).alias("updated_at"))
    return checkpoints.join(marks.select("connector_id"), "connector_id", "left_anti").unionByName(moved)


def fold_run_state(run_events: DataFrame) -> DataFrame:
    """Current ledger row per run out of its appended events, the greatest ``seq`` winning.

    ``started_at`` comes from the first event, everything else from the last.
    """
    last = ["connector_id", "status", "finished_at", "upserts_count", "deletes_count", "error_class", "error_message"]
    folded = run_events.groupBy("run_id").agg(
        F.max_by(F.struct(*last), "seq").alias("last"), F.min_by("started_at", "seq").alias("started_at")
    )
    return folded.select(
        "run_id",
        "last.connector_id",
        "last.status",
        "started_at",
        "last.finished_at",
        F.coalesce("last.upserts_count", F.lit(0)).alias("upserts_count"),
        F.coalesce("last.deletes_count", F.lit(0)).alias("deletes_count"),
        "last.error_class",
        "last.error_message",
    )
