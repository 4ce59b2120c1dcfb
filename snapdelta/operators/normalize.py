"""Rows to canonical documents, by column expressions only."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapdelta.functions.template import compile_template
from snapdelta.functions.text import (
    field_type,
    has_field,
    instant,
    iso_instant,
    iso_text,
    plain_text,
    ref,
    sha256_text,
    shown_text,
    utc,
)

# Map column of JSON values by name; where rows have it, metadata is taken from there as it is.
FACTS = "_facts"
DOC_COLUMNS = [
    "doc_id",
    "title",
    "content",
    "uri",
    "mime_type",
    "updated_at",
    "acl_users",
    "acl_groups",
    "metadata",
    "checksum",
    "op",
]
# ``metadata`` is a JSON object as text, so documents of all connectors share one schema.
DOC_SCHEMA = (
    "doc_id string, title string, content string, uri string, mime_type string, updated_at timestamp, "
    "acl_users array<string>, acl_groups array<string>, metadata string, checksum string, op string"
)


class NormalizationError(ValueError):
    """The rows lack a column that the mapping needs."""


@dataclass(frozen=True)
class Mapping:
    """How source columns become a document."""

    id_field: str
    title_field: str
    content_template: str
    uri_template: str | None = None
    mime_type: str = "text/plain"
    acl_users_field: str | None = None
    acl_groups_field: str | None = None
    metadata_fields: tuple[str, ...] = ()


def acl(df: DataFrame, field: str | None) -> Column:
    """A column as a list of names: null is empty, text is one name, null items are dropped."""
    none = F.array().cast("array<string>")
    if not field or not has_field(df, field):
        return none
    kind, column = field_type(df, field), ref(field)
    if isinstance(kind, T.ArrayType):
        kept = F.filter(column, lambda item: item.isNotNull())
        names = F.transform(kept, lambda item: plain_text(item, kind.elementType))
    else:
        names = F.when(column.isNotNull(), F.array(plain_text(column, kind)))
    return F.coalesce(names, none)


def updated_at(df: DataFrame, field: str | None, run_ts: datetime | str) -> Column:
    """Source time of a row. Timestamps and ISO text count, anything else gives the run time."""
    now = utc(run_ts)
    if not field or not has_field(df, field):
        return now
    kind, column = field_type(df, field), ref(field)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.coalesce(instant(column), now)
    if isinstance(kind, T.StringType):
        bad = F.raise_error(F.concat(F.lit("not an ISO time: "), column)).cast("timestamp")
        return F.when(column.isNull(), now).otherwise(F.coalesce(iso_instant(column), bad))
    return now


def _metadata_value(df: DataFrame, name: str) -> Column:
    kind, column = field_type(df, name), ref(name)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return iso_text(column)
    if isinstance(kind, (T.DecimalType, T.DateType)):
        return column.cast("string")
    return column


def metadata(df: DataFrame, connector_id: str, fields: tuple[str, ...]) -> Column:
    """Struct of the connector id and those listed fields that the rows have, keys sorted."""
    values = {"connector_id": F.lit(connector_id)}
    values |= {name: _metadata_value(df, name) for name in fields if has_field(df, name)}
    return F.struct(*[values[name].alias(name) for name in sorted(values)])


def _facts_text(connector_id: str) -> Column:
    """JSON object of the connector id and the row's own JSON values, keys sorted."""
    own = F.transform(F.map_entries(F.col(FACTS)), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))
    connector = F.struct(F.lit("connector_id").alias("k"), F.lit(json.dumps(connector_id)).alias("v"))
    entries = F.sort_array(F.concat(F.filter(own, lambda e: e["k"] != "connector_id"), F.array(connector)))
    quoted = F.transform(entries, lambda e: F.concat(F.lit('"'), F.regexp_replace(e["k"], r'(["\\])', r"\\$1"), F.lit('":'), e["v"]))
    return F.concat(F.lit("{"), F.array_join(quoted, ","), F.lit("}"))


def json_text(column: Column) -> Column:
    """JSON text with nulls kept."""
    return F.to_json(column, {"ignoreNullFields": "false"})


def _require(df: DataFrame, mapping: Mapping) -> None:
    for what, name in (("id", mapping.id_field), ("title", mapping.title_field)):
        if not has_field(df, name):
            raise NormalizationError(f"missing {what} field '{name}' in source rows")


def doc_id(df: DataFrame, mapping: Mapping, connector_id: str) -> Column:
    """``connector:id`` of a row."""
    return F.concat(F.lit(f"{connector_id}:"), shown_text(ref(mapping.id_field), field_type(df, mapping.id_field)))


def normalize(
    df: DataFrame,
    mapping: Mapping,
    connector_id: str,
    watermark_field: str | None,
    run_ts: datetime | str,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One canonical document per row, as upserts, with any source columns named in ``keep``.

    The checksum covers everything a reader of the document sees; it leaves out ``updated_at`` and
    ``op``, so a row whose time alone moved is not a change. Two plain selects, no shuffle.
    """
    _require(df, mapping)
    no_uri = F.lit(None).cast("string")
    fields = df.select(
        doc_id(df, mapping, connector_id).alias("doc_id"),
        shown_text(ref(mapping.title_field), field_type(df, mapping.title_field)).alias("title"),
        compile_template(mapping.content_template, df).alias("content"),
        (compile_template(mapping.uri_template, df) if mapping.uri_template else no_uri).alias("uri"),
        F.lit(mapping.mime_type).alias("mime_type"),
        updated_at(df, watermark_field, run_ts).alias("updated_at"),
        acl(df, mapping.acl_users_field).alias("acl_users"),
        acl(df, mapping.acl_groups_field).alias("acl_groups"),
        (_facts_text(connector_id) if FACTS in df.columns else metadata(df, connector_id, mapping.metadata_fields)).alias("facts"),
        *keep,
    )
    hashed = F.struct("acl_groups", "acl_users", "content", "doc_id", F.col("facts").alias("metadata"), "mime_type", "title", "uri")
    columns = {name: F.col(name) for name in DOC_COLUMNS[:8]}
    columns["metadata"] = F.col("facts") if FACTS in df.columns else json_text(F.col("facts"))
    columns["checksum"] = sha256_text(json_text(hashed))
    columns["op"] = F.lit("UPSERT")
    return fields.select(*[columns[name].alias(name) for name in DOC_COLUMNS], *keep)


def changed_rows(df: DataFrame, changed: DataFrame, mapping: Mapping, connector_id: str) -> DataFrame:
    """Source rows whose document id is among ``changed.doc_id``; the join sits right on the source."""
    _require(df, mapping)
    key = doc_id(df, mapping, connector_id)
    return df.join(changed.select(F.col("doc_id").alias("_changed_id")), key == F.col("_changed_id"), "left_semi")
