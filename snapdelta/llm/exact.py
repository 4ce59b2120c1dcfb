"""Exact deduplication in skew-safe steps: combine locally, merge salted groups, then combine the salt winners.

Texts are equal when identical; null counts as empty. Each step groups by the digest and the full text, so contents are
compared and not only digests. The salt is the map partition, so one task's copies are already one row before the first
shuffle, a group of any size reaches at most ``salts`` tasks, and the last step sees at most ``salts`` rows of a group.

Defined results: of equal texts the row with the largest ``doc_id`` stays; null ids rank below all others, and a group of
null ids only keeps them. Rows that agree in text and ``doc_id`` are one document: ``labelled`` gives them the same label
and ``survivors`` returns one of them. Empty tables give empty results. Further columns are carried by ``survivors`` and
ignored by ``labelled``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapdelta.session import settled

SALTS = 16


def _contents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))


def _keyed(contents: DataFrame) -> DataFrame:
    """Two digests of unlike kinds and the length: the name under which a content is found again."""
    return contents.withColumns(
        {"text_sha256": F.sha2("text", 256), "second": F.xxhash64("text"), "n_bytes": F.octet_length("text")}
    )


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per distinct text: its digests, the id that stays and the number of rows. Written once."""
    contents = _keyed(_contents(docs, id_col, text_col))
    salted = contents.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    name = ["text_sha256", "second", "n_bytes", "text"]
    merged = salted.groupBy("salt", *name).agg(F.max("doc_id").alias("best"), F.count(F.lit(1)).alias("copies"))
    combined = merged.groupBy(*name).agg(F.max("best").alias("keep_id"), F.sum("copies").alias("group_size"))
    return settled(combined.drop("text"), "exact-groups")


def labelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """Every row's id with ``keep_id``, ``group_size``, ``kept`` and the digest; only digests are shuffled for it."""
    found = groups(docs, id_col, text_col, salts)
    rows = _keyed(_contents(docs, id_col, text_col)).drop("text")
    return rows.join(found, ["text_sha256", "second", "n_bytes"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows that stay, with all their columns. The id is part of the join key, so no key is hot."""
    found = groups(docs, id_col, text_col, salts).select(
        *[F.col(c).alias(f"__{c}") for c in ("text_sha256", "second", "n_bytes")],
        F.coalesce(F.col("keep_id").cast("string"), F.lit("")).alias("__keep_id"),
    )
    text = F.coalesce(F.col(text_col), F.lit(""))
    mine = docs.withColumns(
        {
            "__sha": F.sha2(text, 256),
            "__xx": F.xxhash64(text),
            "__len": F.octet_length(text),
            "__id": F.coalesce(F.col(id_col).cast("string"), F.lit("")),
        }
    )
    same = (
        (F.col("__sha") == F.col("__text_sha256"))
        & (F.col("__xx") == F.col("__second"))
        & (F.col("__len") == F.col("__n_bytes"))
        & (F.col("__id") == F.col("__keep_id"))
    )
    stay = mine.join(found, same, "left_semi").dropDuplicates(["__sha", "__xx", "__len", "__id"])
    return stay.select(*[F.col(f"`{c}`") for c in docs.columns])
