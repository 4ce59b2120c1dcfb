"""Snapshot diff: upserts for new and changed documents, tombstones for missing ones."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapdelta.functions.text import instant, sha256_text, utc
from snapdelta.operators.normalize import DOC_COLUMNS, Mapping, changed_rows, json_text, normalize

DELETE_POLICIES = ("auto_delete_missing", "soft_delete_only", "never_delete")


def _check(policy: str) -> None:
    if policy not in DELETE_POLICIES:
        raise ValueError(f"unknown delete policy: {policy}")


def changed_keys(keys: DataFrame, state: DataFrame, policy: str = "auto_delete_missing") -> DataFrame:
    """``doc_id, change, source_updated_at`` for every key that is new, changed or missing.

    ``keys`` needs ``doc_id`` and ``checksum`` only, so one narrow full outer join finds all three
    kinds at once and no content crosses the network.
    """
    _check(policy)
    left = keys.select("doc_id", F.col("checksum").alias("now_sum"))
    right = state.select("doc_id", F.col("checksum").alias("old_sum"), "source_updated_at")
    how = "left" if policy == "never_delete" else "full"
    both = left.join(right, "doc_id", how)
    change = (
        F.when(F.col("old_sum").isNull(), "new")
        .when(F.col("now_sum").isNull(), "missing")
        .when(F.col("now_sum") != F.col("old_sum"), "changed")
    )
    return both.select("doc_id", change.alias("change"), "source_updated_at").where("change is not null")


def changed_against(keys: DataFrame, base: DataFrame, overlay: DataFrame | None, policy: str = "auto_delete_missing") -> DataFrame:
    """``changed_keys`` against a state that is a base table and the last change of each document since.

    ``keys`` and ``base`` in equal buckets of ``doc_id`` meet without an exchange of either; the ``overlay`` (``doc_id``, ``op``,
    ``checksum``, ``updated_at``) is small and joined to what they give. Adds ``old_sum`` and ``now_sum``, the checksums before and now.
    """
    _check(policy)
    left = keys.select("doc_id", F.col("checksum").alias("now_sum"))
    right = base.select("doc_id", F.col("checksum").alias("old_sum"), "source_updated_at")
    both = left.join(right, "doc_id", "left" if policy == "never_delete" else "full")
    if overlay is not None:
        live = F.col("op") != "DELETE"
        over = overlay.select(
            "doc_id", F.lit(True).alias("touched"), F.when(live, F.col("checksum")).alias("over_sum"), F.when(live, F.col("updated_at")).alias("over_time")
        )
        both = both.join(over, "doc_id", "left").select(
            "doc_id",
            "now_sum",
            F.when(F.col("touched"), F.col("over_sum")).otherwise(F.col("old_sum")).alias("old_sum"),
            F.when(F.col("touched"), F.col("over_time")).otherwise(F.col("source_updated_at")).alias("source_updated_at"),
        )
        if policy != "never_delete":
            known = over.where("over_sum is not null")
            alone = known.join(left.select("doc_id"), "doc_id", "left_anti").join(right.select("doc_id"), "doc_id", "left_anti")
            unseen = F.lit(None).cast("string").alias("now_sum")
            both = both.unionByName(alone.select("doc_id", unseen, F.col("over_sum").alias("old_sum"), F.col("over_time").alias("source_updated_at")))
    change = (
        F.when(F.col("old_sum").isNull() & F.col("now_sum").isNotNull(), "new")
        .when(F.col("now_sum").isNull() & F.col("old_sum").isNotNull(), "missing")
        .when(F.col("now_sum") != F.col("old_sum"), "changed")
    )
    return both.select("doc_id", change.alias("change"), "source_updated_at", "old_sum", "now_sum").where("change is not null")


def _tombstone(connector_id: str, policy: str, run_ts: datetime | str) -> dict[str, Column]:
    """Columns of a delete document; expects ``doc_id`` and the stored ``source_updated_at``."""
    soft = policy == "soft_delete_only"
    facts = [F.lit(connector_id).alias("connector_id")]
    if soft:
        facts.append(F.lit(True).alias("soft_delete"))
    nobody = F.array().cast("array<string>")
    return {
        "doc_id": F.col("doc_id"),
        "title": F.lit(""),
        "content": F.lit(""),
        "uri": F.lit(None).cast("string"),
        "mime_type": F.lit("text/plain"),
        "updated_at": instant(F.col("source_updated_at")) if soft else utc(run_ts),
        "acl_users": nobody,
        "acl_groups": nobody,
        "metadata": json_text(F.struct(*facts)),
        "checksum": sha256_text(F.col("doc_id")),
        "op": F.lit("DELETE"),
    }


def tombstones(missing: DataFrame, connector_id: str, policy: str, run_ts: datetime | str) -> DataFrame:
    """Delete documents for the given keys; soft deletes carry the stored source time."""
    _check(policy)
    columns = _tombstone(connector_id, policy, run_ts)
    return missing.select(*[columns[name].alias(name) for name in DOC_COLUMNS])


def delta_of(
    rows: DataFrame,
    changes: DataFrame,
    mapping: Mapping,
    connector_id: str,
    watermark_field: str | None,
    policy: str = "auto_delete_missing",
    run_ts: datetime | str = "1970-01-01",
) -> DataFrame:
    """Delta for the keys found by ``changed_keys``: documents of their rows, and tombstones.

    Give ``changes`` as a written table. Its size is then known: few changes are broadcast to the
    scan of the source rows, so unchanged rows go no further than that; many changes shuffle on
    the id.
    """
    live = changed_rows(rows, changes.where("change <> 'missing'"), mapping, connector_id)
    upserts = normalize(live, mapping, connector_id, watermark_field, run_ts)
    return upserts.unionByName(tombstones(changes.where("change = 'missing'"), connector_id, policy, run_ts))


def diff(
    docs: DataFrame,
    state: DataFrame,
    connector_id: str,
    policy: str = "auto_delete_missing",
    run_ts: datetime | str = "1970-01-01",
) -> DataFrame:
    """Delta of a snapshot against the state in one plan, for narrow documents.

    One join finds upserts and missing keys; documents and the state's narrow columns shuffle once
    on ``doc_id``. Where content is wide, ``changed_keys``, a written table and ``delta_of`` give the
    same delta without shuffling content.
    """
    _check(policy)
    known = state.select("doc_id", F.col("checksum").alias("old_sum"), "source_updated_at")
    if policy == "never_delete":
        both = docs.join(known, "doc_id", "left")
        return both.where("old_sum is null or old_sum <> checksum").select(*DOC_COLUMNS)
    both = docs.join(known, "doc_id", "full").where("checksum is null or old_sum is null or old_sum <> checksum")
    gone = F.col("checksum").isNull()
    dead = _tombstone(connector_id, policy, run_ts)
    return both.select(*[F.when(gone, dead[name]).otherwise(F.col(name)).alias(name) for name in DOC_COLUMNS])


def delta_counts(delta: DataFrame) -> DataFrame:
    """One row: ``upserts_count`` and ``deletes_count``."""
    is_delete = F.col("op") == "DELETE"
    return delta.agg(F.count_if(~is_delete).alias("upserts_count"), F.count_if(is_delete).alias("deletes_count"))


def concat_delta(upserts: DataFrame, deletes: DataFrame) -> DataFrame:
    """Both halves of a delta as one."""
    return upserts.unionByName(deletes)


def canonical_order(delta: DataFrame) -> DataFrame:
    """The delta sorted by operation, id and checksum, by range partitions."""
    return delta.orderBy("op", "doc_id", "checksum")
