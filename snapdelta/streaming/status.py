"""Status counts by hour over a stream of run events: every event counts, however late it comes.

Counts add up, so a micro-batch needs no state of earlier ones: it writes the counts of its own events by span and status under
its number, replaced whole when the batch is repeated. ``status_chart`` adds them up. Old counts are folded into one table
now and then, named by the last batch in it. An event is late when its span had been over for the allowed time before its micro-batch
began; its counts are in a table of their own too, for whoever has read the span before.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from snapdelta.operators.dashboard import status_timechart
from snapdelta.plans.files import Files

_SCHEMA = "span_start timestamp, status string, runs bigint"
FOLD_EVERY = 64


def _numbers(files: Files, folder: str, prefix: str) -> list[int]:
    """Numbers of the finished folders."""
    names = [name for name in files.names(folder) if name.startswith(prefix)]
    return sorted(int(name.removeprefix(prefix)) for name in names if files.exists(f"{folder}/{name}/_SUCCESS"))


def _chart_paths(files: Files, path: str) -> tuple[int, list[str]]:
    """The last folded batch (-1: none), and what together holds every count once."""
    folded = _numbers(files, f"{path}/folded", "upto=")
    upto = folded[-1] if folded else -1
    fresh = [number for number in _numbers(files, f"{path}/counts", "batch=") if number > upto]
    base = [f"{path}/folded/upto={upto}"] if folded else []
    return upto, base + [f"{path}/counts/batch={number}" for number in fresh]


def status_chart(spark: SparkSession, path: str) -> DataFrame:
    """``span_start, status, runs`` of all events the stream has taken in, open spans included."""
    paths = _chart_paths(Files(spark), path)[1]
    if not paths:
        return spark.createDataFrame([], _SCHEMA)
    return spark.read.schema(_SCHEMA).parquet(*paths).groupBy("span_start", "status").agg(F.sum("runs").alias("runs"))


def late_counts(spark: SparkSession, path: str) -> DataFrame:
    """Counts of late events: the ``batch`` that brought them, ``span_start, status, runs``."""
    if not _numbers(Files(spark), f"{path}/late", "batch="):
        return spark.createDataFrame([], f"{_SCHEMA}, batch bigint")
    return spark.read.schema(f"{_SCHEMA}, batch bigint").parquet(f"{path}/late")


def _take_in(frame: DataFrame, number: int, path: str, span: str, late: str) -> None:
    spark = frame.sparkSession
    files = Files(spark)
    note = f"{path}/marks/{number}.json"
    before = json.loads(files.read(f"{path}/marks/{number - 1}.json"))["latest"] if files.exists(f"{path}/marks/{number - 1}.json") else None
    folder = f"{path}/counts/batch={number}"
    status_timechart(frame, "ts", span).write.mode("overwrite").parquet(folder)
    counts = spark.read.schema(_SCHEMA).parquet(folder)
    # Spans are known by their beginnings, and the latest beginning stands for the time the stream has come to.
    over = F.lit(None).cast("boolean") if before is None else F.col("span_start") + F.expr(f"INTERVAL {span} + INTERVAL {late}") <= F.timestamp_micros(F.lit(before))
    counts.where(over).write.mode("overwrite").parquet(f"{path}/late/batch={number}")
    latest = counts.agg(F.unix_micros(F.max("span_start"))).first()[0]
    files.write(note, json.dumps({"latest": max((x for x in (before, latest) if x is not None), default=None)}))
    if number % FOLD_EVERY == FOLD_EVERY - 1:
        _fold(spark, files, path, number)


def _fold(spark: SparkSession, files: Files, path: str, number: int) -> None:
    """Add up all counts to this batch into one table; it counts once it is whole, and what it replaces is removed after that."""
    upto, paths = _chart_paths(files, path)
    if upto >= number:
        return
    total = spark.read.schema(_SCHEMA).parquet(*paths).groupBy("span_start", "status").agg(F.sum("runs").alias("runs"))
    total.write.mode("overwrite").parquet(f"{path}/folded/upto={number}")
    for old in paths:
        files.remove(old)
    for name in files.names(f"{path}/marks"):
        if int(name.removesuffix(".json")) < number:
            files.remove(f"{path}/marks/{name}")


def status_stream(
    run_events: DataFrame, path: str, checkpoint: str, span: str = "1 hour", late: str = "10 minutes", **trigger
) -> StreamingQuery:
    """Keep the counts of a stream of run events by span and status under ``path``, for ``status_chart``.

    A path belongs to one checkpoint.
    """
    events = run_events.select("ts", "status")
    writer = events.writeStream.foreachBatch(lambda frame, number: _take_in(frame, number, path, span, late))
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
