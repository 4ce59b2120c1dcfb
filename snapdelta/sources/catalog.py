"""The connector dimension, from spec documents held as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapdelta.sources.pages import variant_at


def catalog(specs: DataFrame) -> DataFrame:
    """``connector_id, path, mode, schedule, source_type`` out of ``path`` and JSON ``body`` rows.

    Specs without a name are skipped; of several specs with one name the greatest path wins, but
    the connector keeps the place of the first one (``path``) in listings.
    """
    spec = F.col("spec")

    def text(path: str):
        return F.try_variant_get(variant_at(spec, path), "$", "string")

    parsed = specs.select("path", F.try_parse_json("body").alias("spec"))
    rows = parsed.select(
        text("metadata.name").alias("connector_id"),
        "path",
        F.struct(
            text("spec.mode").alias("mode"),
            text("spec.schedule").alias("schedule"),
            text("spec.source.type").alias("source_type"),
        ).alias("facts"),
    )
    named = rows.where("connector_id is not null and connector_id <> ''")
    latest = named.groupBy("connector_id").agg(
        F.min("path").alias("path"), F.max_by("facts", "path").alias("facts")
    )
    return latest.select("connector_id", "path", "facts.mode", "facts.schedule", "facts.source_type")
