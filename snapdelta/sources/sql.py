"""SQL pulls with one bound ``:watermark`` and the high-water mark of what came back."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapdelta.functions.text import field_type, has_field, mark_text, ref


def high_water_mark(df: DataFrame, field: str | None, previous: str | None, typed: bool = False) -> DataFrame:
    """One row with ``watermark``: the greatest text of the field, else the previous mark.

    Marks compare as text, so integers compare digit by digit. Timestamps take their ISO text. With
    ``typed`` the greatest value of the column's own type is taken, and then its text.
    """
    fallback = F.lit(previous).cast("string")
    if not field or not has_field(df, field):
        return df.sparkSession.range(1).select(fallback.alias("watermark"))
    kind = field_type(df, field)
    greatest = mark_text(F.max(ref(field)), kind) if typed else F.max(mark_text(ref(field), kind))
    return df.agg(greatest.alias("watermark")).select(F.coalesce("watermark", fallback).alias("watermark"))


def sql_pull(
    spark: SparkSession, query: str, watermark: str | None = None, watermark_field: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Run the query over registered tables; returns its rows and the new mark.

    A null mark makes ``column > :watermark`` select nothing. Write
    ``(:watermark IS NULL OR column > :watermark)`` where the first pull should take everything.
    """
    rows = spark.sql(query, args={"watermark": watermark})
    return rows, high_water_mark(rows, watermark_field, watermark)


# What a query text is made of: quoted texts and names, comments, and the bound name as a whole word.
_PARTS = re.compile(
    r"""'(?:[^']|'')*'|"(?:[^"]|"")*"|`[^`]*`|--[^\n]*|/\*.*?\*/|(?P<mark>(?<![:\w]):watermark\b)""", re.DOTALL
)


def _sql_text(value: str | None, dialect: str | None = None) -> str:
    """A text literal; MySQL also takes backslashes for escapes."""
    if value is None:
        return "NULL"
    quoted = value.replace("'", "''")
    return "'" + (quoted.replace("\\", "\\\\") if dialect == "mysql" else quoted) + "'"


def bound_query(query: str, watermark: str | None, dialect: str | None = None) -> str:
    """The query with ``:watermark`` replaced wherever it stands as a word of its own outside of quotes and comments."""
    return _PARTS.sub(lambda m: _sql_text(watermark, dialect) if m["mark"] else m[0], query)


def jdbc_options(
    query: str,
    watermark: str | None = None,
    partition_column: str | None = None,
    bounds: tuple[str, str] | None = None,
    partitions: int = 1,
    fetch_size: int = 10_000,
    dialect: str | None = None,
) -> dict[str, str]:
    """Reader options for a pull from an external database.

    With a partition column and its bounds the database is read by ``partitions`` range queries at
    once; rows outside the bounds still come with the first and last range.
    """
    query = bound_query(query, watermark, dialect)
    options = {"dbtable": f"({query.strip().rstrip(';')}) pulled", "fetchsize": str(fetch_size)}
    if partition_column:
        if not bounds or partitions < 1:
            raise ValueError("a partition column needs bounds and a number of partitions")
        options |= {
            "partitionColumn": partition_column,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(partitions),
        }
    return options


def jdbc_pull(
    spark: SparkSession,
    connection: dict[str, str],
    query: str,
    watermark: str | None = None,
    watermark_field: str | None = None,
    **ranges,
) -> tuple[DataFrame, DataFrame]:
    """``sql_pull`` against an external database; ``connection`` holds url, user, driver and so on."""
    options = connection | jdbc_options(query, watermark, **ranges)
    rows = spark.read.format("jdbc").options(**options).load()
    return rows, high_water_mark(rows, watermark_field, watermark)
