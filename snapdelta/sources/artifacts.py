"""Reading published delta documents back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapdelta.operators.normalize import DOC_COLUMNS, DOC_SCHEMA
from snapdelta.plans.files import Files


def read_delta(spark: SparkSession, path: str) -> DataFrame:
    """Canonical documents of an NDJSON file or folder; a missing path gives no documents.

    Blank lines are skipped. A line that is not a document of the right form fails the query.
    """
    if not Files(spark).exists(path):
        return spark.createDataFrame([], DOC_SCHEMA)
    lines = spark.read.text(path).where(F.col("value").rlike(r"\S")).select("value", F.parse_json("value").alias("parsed"))
    value = F.col("parsed")

    def text(name: str):
        return F.variant_get(value, f"$.{name}", "string")

    def names(name: str):
        return F.coalesce(F.variant_get(value, f"$.{name}", "array<string>"), F.array().cast("array<string>"))

    def required(name: str):
        problem = F.concat(F.lit(f"document without {name}: "), F.left("value", F.lit(200)))
        return F.coalesce(text(name), F.raise_error(problem).cast("string"))

    columns = {
        "doc_id": required("doc_id"),
        "title": required("title"),
        "content": required("content"),
        "uri": text("uri"),
        "mime_type": F.coalesce(text("mime_type"), F.lit("text/plain")),
        "updated_at": required("updated_at").cast("timestamp"),
        "acl_users": names("acl_users"),
        "acl_groups": names("acl_groups"),
        "metadata": F.coalesce(F.to_json(F.variant_get(value, "$.metadata", "variant")), F.lit("{}")),
        "checksum": required("checksum"),
        "op": required("op"),
    }
    return lines.select(*[columns[name].alias(name) for name in DOC_COLUMNS])
