"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from snapdelta.plans.files import Files

# Settings the operators count on. Partition numbers are left to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    # Of equal keys in a JSON object the last counts, as in most readers.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def tuned(builder):
    """Apply the settings to a session builder and return it."""
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting for the time of a block."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and spark.sparkContext.master.startswith("local"):
        base = tempfile.mkdtemp(prefix="snapdelta-")
        spark.sparkContext.setCheckpointDir(base)
    if not base:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    return base.rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/snapdelta/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; nothing is created until something is written."""
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove what this application has put under the shared folder, once its frames are done with."""
    Files(spark).remove(_own_folder(spark))


def settled(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read back, for plans that use them again.

    Later steps start from files that outlive any executor, and read only the columns they need.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
