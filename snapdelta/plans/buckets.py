"""Tables in buckets of ``doc_id``, with a digest of every bucket.

Rows of one bucket are one file, and Spark knows by the table's definition that equal ids are in equal buckets: a join of
two tables with as many buckets moves neither. Digests of the ids and checksums of a bucket are sums in which the order of rows
does not matter and from which rows can be taken out again, so two tables are compared by their digests first, and only
the files of buckets that differ are read. Definitions are external ones over the files, made anew in a session that lacks them.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of a bucket that a new table aims at.
BUCKET_ROWS = 250_000

# Rows, and two exclusive-or sums of unlike hashes.
Digest = tuple[int, int, int]
EMPTY: Digest = (0, 0, 0)


def bucket_count(spark: SparkSession, rows: int) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-rows // BUCKET_ROWS))


def bucket_of(buckets: int, column: str = "doc_id") -> Column:
    """The bucket that Spark deals a row to."""
    return F.pmod(F.hash(column), F.lit(buckets))


def _name(path: str) -> str:
    return "snapdelta_" + hashlib.md5(path.encode()).hexdigest()


def write_buckets(df: DataFrame, path: str, buckets: int, dealt: bool = False) -> DataFrame:
    """Write the rows in buckets. ``dealt`` says that each task holds rows of one bucket already, as after a join of such tables."""
    spark = df.sparkSession
    forget_buckets(spark, path)
    rows = df if dealt else df.repartition(buckets, "doc_id")
    writer = rows.write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, "doc_id").sortBy("doc_id")
    writer.saveAsTable(_name(path))
    return read_buckets(spark, path, df.schema, buckets)


def read_buckets(spark: SparkSession, path: str, schema, buckets: int, only: list[int] | None = None) -> DataFrame:
    """The rows, or those of some buckets, whose files alone are read then."""
    name = _name(path)
    if not spark.catalog.tableExists(name):
        columns = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        place = path.replace("'", "\\'")
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (doc_id) SORTED BY (doc_id) INTO {buckets} BUCKETS LOCATION '{place}'")
    table = spark.table(name)
    if only is None:
        return table
    number = F.regexp_extract("_metadata.file_name", r"_(\d+)(?:\..*)?$", 1).cast("int")
    return table.where(number.isin(only))


def forget_buckets(spark: SparkSession, path: str) -> None:
    """Drop the session's definition; the files stay."""
    spark.sql(f"DROP TABLE IF EXISTS {_name(path)}")


def digest_columns(doc_id: str = "doc_id", checksum: str = "checksum") -> list[Column]:
    """Aggregates for the digest of some rows; rows without a checksum do not count."""
    held = F.col(checksum).isNotNull()
    first = F.when(held, F.xxhash64(doc_id, checksum))
    second = F.when(held, F.xxhash64(F.lit("second"), checksum, doc_id))
    return [F.count_if(held).alias("rows"), F.coalesce(F.bit_xor(first), F.lit(0)).alias("first"), F.coalesce(F.bit_xor(second), F.lit(0)).alias("second")]


def digests(df: DataFrame, buckets: int) -> dict[int, Digest]:
    """The digest of each bucket that has rows."""
    found = df.groupBy(bucket_of(buckets).alias("bucket")).agg(*digest_columns()).collect()
    return {row["bucket"]: (row["rows"], row["first"], row["second"]) for row in found}


def moved(before: dict[int, Digest], gone: dict[int, Digest], come: dict[int, Digest]) -> dict[int, Digest]:
    """Digests after some rows have gone and others have come."""
    after = dict(before)
    for sign, rows in ((-1, gone), (1, come)):
        for bucket, (n, first, second) in rows.items():
            old = after.get(bucket, EMPTY)
            after[bucket] = (old[0] + sign * n, old[1] ^ first, old[2] ^ second)
    return {bucket: digest for bucket, digest in after.items() if digest != EMPTY}


def differing(a: dict[int, Digest], b: dict[int, Digest]) -> list[int]:
    return sorted(bucket for bucket in a.keys() | b.keys() if a.get(bucket, EMPTY) != b.get(bucket, EMPTY))
