"""Output forms of documents: canonical lines and the index envelope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapdelta.functions.text import base64_line, has_ink, index_id, iso_text, zulu_text
from snapdelta.operators.normalize import DOC_COLUMNS, json_text


def shown_content(content: str = "content", title: str = "title", key: str = "doc_id") -> Column:
    """Content, or the title where it is blank, or the id where both are."""
    return F.when(has_ink(F.col(content)), F.col(content)).when(has_ink(F.col(title)), F.col(title)).otherwise(F.col(key))


def _struct_data() -> Column:
    """What the index keeps beside the content, keys in order."""
    return F.struct(
        "acl_groups",
        "acl_users",
        "checksum",
        "doc_id",
        F.parse_json("metadata").alias("metadata"),
        "title",
        iso_text(F.col("updated_at")).alias("updated_at"),
        "uri",
    )


def index_envelope(docs: DataFrame) -> DataFrame:
    """``id``, ``struct_data`` (JSON text), ``mime_type`` and ``raw_bytes`` (base64) per document."""
    return docs.select(
        index_id(F.col("doc_id")).alias("id"),
        json_text(_struct_data()).alias("struct_data"),
        "mime_type",
        base64_line(shown_content()).alias("raw_bytes"),
    )


def index_line(docs: DataFrame) -> DataFrame:
    """One JSON line per document as the index imports it."""
    content = F.struct(F.col("mime_type").alias("mimeType"), base64_line(shown_content()).alias("rawBytes"))
    envelope = F.struct(
        content.alias("content"), index_id(F.col("doc_id")).alias("id"), _struct_data().alias("structData")
    )
    return docs.select(json_text(envelope).alias("value"))


def canonical_json(docs: DataFrame) -> DataFrame:
    """One canonical JSON line per document, fields in contract order, nulls kept."""
    special = {
        "updated_at": zulu_text(F.col("updated_at")),
        "metadata": F.parse_json("metadata"),
    }
    fields = [special.get(name, F.col(name)).alias(name) for name in DOC_COLUMNS]
    return docs.select(json_text(F.struct(*fields)).alias("value"))
