"""Push intake as a stream: idempotent, safe to repeat after a failure.

The stream keeps one value per idempotency key in keyed state: the hash of the request that took the key, and the stream and
micro-batch where its answer lies. A micro-batch looks up the keys it holds and no others, however many were used before. The
state belongs to the checkpoint and moves on with it, so a repeated micro-batch finds the state as it was. It is the state of an
aggregation, which Spark keeps without a call into Python per key; a key whose requests were all unsound has an empty value in it.

Requests go through the state as claims: of each part of a micro-batch the first acceptable request per key, without bodies, so
a key that holds a third of all requests is a few narrow rows there. Requests and the claims' answers come out of one
plan, are written once, and meet again in a join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from snapdelta.operators.gates import flag_rejects, validate_documents
from snapdelta.operators.normalize import DOC_COLUMNS
from snapdelta.operators.queue import acceptable, check_targets, classify_requests, judged
from snapdelta.plans.store import KEY_SCHEMA, Store, settle
from snapdelta.session import setting
from snapdelta.sources.push import body_hash, parse_requests, push_events

# Columns of a request row, in tables and in streams. ``request_id`` is unique, for instance the
# partition and offset under which the request arrived.
REQUEST_SCHEMA = (
    "request_id string, key string, connector_id string, received_at timestamp, content_type string, body string"
)
_NARROW = ("request_id", "key", "connector_id", "received_at", "request_hash")

# Fixed names: Spark's setting for the kind of state store, its value for RocksDB, and the property that numbers a micro-batch.
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_BATCH_NUMBER = "streaming.sql.batchId"

# Stands for a time that is absent; it comes before all others.
_NO_TIME = -(2**63)
# The turn of keys that were taken before the stream began; micro-batches count from 0.
_BEFORE = -1
_CLAIM = "key string, at bigint, request_id string, request_hash string, turn bigint"
_EARLIER = "key string, request_hash string, stream string, batch_id bigint"


def _claims(parsed: DataFrame) -> DataFrame:
    """Of each batch of rows, per key the first request that may take it, with the number of the micro-batch as ``turn``; a key
    without such a request keeps a row with a null hash.
    """
    rows = parsed.where("key <> ''").select(
        "key",
        F.coalesce(F.unix_micros("received_at"), F.lit(_NO_TIME)).alias("at"),
        "request_id",
        F.when(acceptable(parsed), F.col("request_hash")).alias("request_hash"),
    )

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = int(TaskContext.get().getLocalProperty(_BATCH_NUMBER))
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table.append_column("bad", pc.is_null(table["request_hash"]))
            order = [(name, "ascending") for name in ("key", "bad", "at", "request_id")]
            table = table.take(pc.sort_indices(table, sort_keys=order)).combine_chunks()
            if table.num_rows:
                key = table["key"].chunk(0)
                starts = pa.concat_arrays([pa.array([True]), pc.not_equal(key[1:], key[:-1])])
                table = table.filter(starts).select(batch.schema.names)
                yield from table.append_column("turn", pa.repeat(pa.scalar(turn, pa.int64()), table.num_rows)).to_batches()

    return rows.mapInArrow(first, _CLAIM)


def _answers(claims: DataFrame, earlier: DataFrame, stream: str) -> DataFrame:
    """One row per key that a micro-batch asks for: who had taken it before, or else its first claim here.

    An aggregation is the keyed state: of each key its first claim ever, as turns come in order, and the last turn that asked for it.
    """
    asking = claims.select("*", F.lit(stream).alias("stream"), F.col("turn").alias("batch_id"))
    before = earlier.select("key", F.lit(_NO_TIME).alias("at"), F.lit("").alias("request_id"), "request_hash", F.lit(_BEFORE).cast("bigint").alias("turn"), "stream", "batch_id")
    use = F.struct("turn", "at", "request_id", "request_hash", "stream", "batch_id")
    found = asking.unionByName(before).groupBy("key").agg(
        F.min(F.when(F.col("request_hash").isNotNull(), use)).alias("use"), F.max("turn").alias("asked")
    )
    known = F.col("use.turn") < F.col("asked")
    return found.where(F.col("asked") > _BEFORE).select(
        "key",
        *[F.when(known, F.col(f"use.{name}")).alias(to) for name, to in (("request_hash", "known_hash"), ("stream", "known_stream"), ("batch_id", "known_batch"))],
        *[F.when(~known, F.col(f"use.{name}")).alias(to) for name, to in (("at", "at"), ("request_id", "first_id"), ("request_hash", "first_hash"))],
    )


def _take_in(store: Store, requests: DataFrame, taken: DataFrame, answers: DataFrame, part: str, staged: str) -> None:
    """Write what a micro-batch brings: queue events, keys, batches and one response per request.

    Every table gets the folder of this stream and batch id, replaced whole, so a repeated batch changes nothing.
    Batches are written after events and keys; a drain sees a batch only when the rest is there.
    ``answers`` are the responses of keys that were taken before.
    """
    spark = store.spark

    def place(table: str) -> str:
        return f"{store.root}/push/{table}/{part}"

    originals = taken.where("outcome = 'original'")
    bodies = requests.select("request_id", "content_type", "body").join(
        originals.select("request_id", "run_id", "connector_id", "received_at"), "request_id"
    )
    events = push_events(parse_requests(bodies), ("run_id", "connector_id", "received_at"))
    flagged = flag_rejects(validate_documents(events)).select(
        "run_id", "connector_id", "pos", F.col("received_at").alias("created_at"), "accepted", *DOC_COLUMNS
    )
    checked = settle(flagged, f"{staged}/checked")
    checked.where("accepted").drop("accepted").write.mode("overwrite").parquet(place("events"))

    counts = checked.groupBy("run_id").agg(
        F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected")
    )
    zero = F.lit(0).cast("bigint")
    answered = originals.join(counts, "run_id", "left").select(
        "key",
        "connector_id",
        "run_id",
        "request_hash",
        F.col("received_at").alias("created_at"),
        F.coalesce("accepted", zero).alias("accepted"),
        F.coalesce("rejected", zero).alias("rejected"),
    )
    response = F.to_json(F.struct("accepted", "rejected", "run_id"))
    answered.select("key", "connector_id", "request_hash", response.alias("response_json"), "created_at").write.mode(
        "overwrite"
    ).parquet(place("keys"))
    store.add_batches(answered, part)

    fresh = spark.read.parquet(place("keys")).select("key", "response_json")
    responses = answers.select("key", "response_json").unionByName(fresh)
    known_answer = F.when(F.col("outcome").isin("original", "replay"), F.col("response_json"))
    taken.join(responses, "key", "left").select(
        "request_id", "key", "outcome", known_answer.alias("response_json")
    ).write.mode("overwrite").parquet(place("responses"))
    store.files.remove(staged)


def intake_batch(
    store: Store, requests: DataFrame, batch_id: int, stream: str = "main", catalog: DataFrame | None = None
) -> None:
    """Take in one table of requests, without a stream: the keys used before are read from the store.

    Keys of the batch itself are left out of the lookup, so a repeated batch changes nothing. With a ``catalog``, requests
    for connectors that do not take pushes are refused.
    """
    part = f"stream={stream}/batch_id={batch_id}"
    staged = f"{store.root}/push/staging/{part}"
    is_mine = (F.col("stream") == stream) & (F.col("batch_id") == batch_id)
    asked = requests.where("key <> ''").select("key").distinct()
    earlier = store.keys().where(~is_mine).select("key", "request_hash", "response_json")
    known = settle(earlier.join(asked, "key", "left_semi"), f"{staged}/known")
    parsed = settle(parse_requests(requests).select(*_NARROW, "body_error"), f"{staged}/parsed")
    outcomes = classify_requests(parsed if catalog is None else check_targets(parsed, catalog), known)
    taken = settle(outcomes.withColumn("run_id", F.md5("key")), f"{staged}/taken")
    _take_in(store, requests, taken, known, part, staged)


def _with_answers(requests: DataFrame, stream: str, earlier: DataFrame, catalog: DataFrame | None) -> DataFrame:
    """The stream's requests, and one row per key of a micro-batch with what the state knows of it and its first claim."""
    parsed = parse_requests(requests)
    claims = _claims(parsed if catalog is None else check_targets(parsed, catalog))
    answers = _answers(claims, earlier, stream)
    return requests.withColumn("kind", F.lit("request")).unionByName(answers.withColumn("kind", F.lit("answer")), allowMissingColumns=True)


def _stateful_batch(store: Store, frame: DataFrame, number: int, stream: str, catalog: DataFrame | None) -> None:
    """Take in one micro-batch of ``_with_answers``. Its plan moves the state, so it is run once: written, and read from there."""
    part = f"stream={stream}/batch_id={number}"
    staged = f"{store.root}/push/staging/{part}"
    frame.write.mode("overwrite").partitionBy("kind").parquet(f"{staged}/frame")
    both = store.spark.read.schema(frame.schema).parquet(f"{staged}/frame")
    answers = both.where("kind = 'answer'").select("key", "known_hash", "known_stream", "known_batch", "at", "first_id", "first_hash")
    requests = both.where("kind = 'request'").select(*[field.split()[0] for field in REQUEST_SCHEMA.split(", ")])
    narrow = requests.withColumn("request_hash", body_hash(F.col("body"))).select(*_NARROW)
    first_at = F.when(F.col("at") != _NO_TIME, F.timestamp_micros("at"))
    claims = answers.select("key", first_at.alias("first_at"), "first_id", "first_hash", "known_hash")
    outcomes = judged(narrow if catalog is None else check_targets(narrow, catalog), claims)
    taken = settle(outcomes.withColumn("run_id", F.md5("key")), f"{staged}/taken")
    # Only the folders that hold an answer asked for again are read; there are no more of them than earlier micro-batches.
    known = answers.where("known_hash IS NOT NULL").select("key", F.col("known_stream").alias("stream"), F.col("known_batch").alias("batch_id"))
    places = [(row["stream"], row["batch_id"]) for row in known.select("stream", "batch_id").distinct().collect()]
    told = store.queue_at("keys", KEY_SCHEMA, places).join(known, ["key", "stream", "batch_id"], "left_semi")
    _take_in(store, requests, taken, told, part, staged)


def _earlier_keys(store: Store, checkpoint: str) -> DataFrame:
    """The keys that the store had when the stream began, as a stream that ends with its first micro-batch.

    They are written beside the checkpoint once, before anything is taken in, so a first micro-batch that is repeated finds the same.
    """
    path = f"{checkpoint}/earlier_keys"
    if not store.files.exists(f"{path}/_SUCCESS"):
        store.keys().select("key", "request_hash", "stream", "batch_id").write.mode("overwrite").parquet(path)
    return store.spark.readStream.schema(_EARLIER).parquet(path)


def intake_stream(
    store: Store, requests: DataFrame, checkpoint: str, catalog: DataFrame | None = None, **trigger
) -> StreamingQuery:
    """Start the intake on a streaming frame of requests; ``trigger`` goes to ``writeStream``.

    Batch numbers belong to the checkpoint, so its name is part of the folders: a stream begun
    anew does not replace what an earlier one has queued. It begins with the keys that the store has then; what other
    streams accept later it does not see, so a store has one stream at a time.
    """
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    frame = _with_answers(requests, name, _earlier_keys(store, checkpoint), catalog)
    writer = frame.writeStream.foreachBatch(lambda batch, number: _stateful_batch(store, batch, number, name, catalog))
    with setting(store.spark, _PROVIDER, _ROCKSDB):
        return writer.outputMode("update").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
