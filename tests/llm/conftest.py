from __future__ import annotations

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text) pairs or whole rows."""

    def make(rows, parts: int = 3):
        full = [tuple(r) + ("en", "src1", len(r[1] or ""))[len(r) - 2 :] if len(r) < 5 else tuple(r) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)

    return make
