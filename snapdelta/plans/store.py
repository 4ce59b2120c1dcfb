"""Connector tables in a shared folder: commits, record state, index table, run events, push queue.

A commit is one small JSON file that names the table files in force, the mark and the drained batch.
It is written once, last, under the next free number, so a run shows up whole or not at all, and two
runs of one connector cannot both commit on the same base. Table files are never changed.

The state is a base table in buckets plus the deltas committed since. Deltas are small against the base, so a
run writes only what has changed; ``compact`` folds them into a new base now and then. The index table's base
is in parts, of which a compaction writes those anew that its deltas touch.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict, dataclass, replace
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapdelta.functions.text import index_id
from snapdelta.operators.envelope import index_envelope
from snapdelta.operators.normalize import DOC_SCHEMA
from snapdelta.operators.ranges import numbered
from snapdelta.operators.state import STATE_SCHEMA, fold_run_state
from snapdelta.plans.buckets import Digest, bucket_count, digests, read_buckets, write_buckets
from snapdelta.plans.files import Files

TARGET_SCHEMA = "id string, struct_data string, mime_type string, raw_bytes string"
_EVENT_SCHEMA = (
    "run_id string, seq bigint, connector_id string, status string, started_at timestamp, finished_at timestamp, "
    "upserts_count bigint, deletes_count bigint, error_class string, error_message string, manifest_path string"
)
_COMMIT_SCHEMA = "connector_id string, watermark string, updated_at timestamp"
BATCH_SCHEMA = (
    "run_id string, connector_id string, idempotency_key string, status string, accepted bigint, rejected bigint, "
    "created_at timestamp, pos bigint"
)
QUEUE_EVENT_SCHEMA = "run_id string, connector_id string, pos int, created_at timestamp, " + DOC_SCHEMA
# Size that a part of the index table aims at.
PART_BYTES = 64 << 20
# Batches have one number per stream: the micro-batch above these bits, the position in it below.
_POSITION_BITS = 32
KEY_SCHEMA = "key string, connector_id string, request_hash string, response_json string, created_at timestamp"


def settle(df: DataFrame, path: str) -> DataFrame:
    """Write the rows and read them back, so that what follows starts from files."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class Commit:
    """Everything in force for a connector after a run."""

    connector_id: str
    version: int = 0
    run_id: str | None = None
    watermark: str | None = None
    updated_at: str | None = None
    batch_id: str | None = None
    state_base: str | None = None
    state_deltas: tuple[tuple[str, str], ...] = ()
    target_base: str | None = None
    target_deltas: tuple[tuple[str, str], ...] = ()
    # The state's base is in buckets of ``doc_id`` (none: a plain table), and a file has the digest of each as of this commit.
    state_buckets: int = 0
    state_digests: str | None = None
    # The index table's base is in parts of the id; a file names the folder of each.
    target_parts: str | None = None
    # Numbers of the push batches that are done, as ranges with both ends: (stream, first, last).
    drained: tuple[tuple[str, int, int], ...] = ()


@dataclass(frozen=True)
class Waiting:
    """Push batches of a connector that no commit has drained, and the micro-batches that were read to find them."""

    batches: DataFrame
    places: tuple[tuple[str, int], ...]


def batch_number() -> Column:
    """The number of a push batch in its stream."""
    return F.shiftleft(F.col("batch_id"), _POSITION_BITS) + F.col("pos")


def merged_ranges(ranges) -> tuple[tuple[str, int, int], ...]:
    """Ranges that touch or overlap become one."""
    out: list[list] = []
    for stream, first, last in sorted(ranges):
        if out and out[-1][0] == stream and first <= out[-1][2] + 1:
            out[-1][2] = max(out[-1][2], last)
        else:
            out.append([stream, first, last])
    return tuple(tuple(one) for one in out)


def _whole(stream: str, batch_id: int) -> tuple[str, int, int]:
    """All numbers of a micro-batch."""
    return stream, batch_id << _POSITION_BITS, ((batch_id + 1) << _POSITION_BITS) - 1


class Store:
    def __init__(self, spark: SparkSession, root: str, part_bytes: int = PART_BYTES):
        self.spark = spark
        self.root = root.rstrip("/")
        self.part_bytes = part_bytes
        self.files = Files(spark)

    # Commits

    def _commits(self, connector_id: str) -> str:
        return f"{self.root}/tables/{connector_id}/commits"

    def _head_note(self, connector_id: str) -> str:
        return f"{self.root}/heads/{connector_id}.json"

    def _commit_file(self, connector_id: str, version: int) -> str:
        return f"{self._commits(connector_id)}/{version:012d}.json"

    def head(self, connector_id: str) -> Commit:
        """The last commit, or an empty one.

        A note beside the commits holds a copy of the last; commits after it (a failure came between) are found by
        their numbers, and the note is then put right. So no commit is listed, however many there are.
        """
        note = self._head_note(connector_id)
        text = self.files.read(note) if self.files.exists(note) else None
        noted = version = json.loads(text)["version"] if text else 0
        while self.files.exists(self._commit_file(connector_id, version + 1)):
            version += 1
        if not version:
            return Commit(connector_id)
        if version > noted:
            text = self.files.read(self._commit_file(connector_id, version))
            self.files.write(note, text)
        raw = json.loads(text)
        for name in ("state_deltas", "target_deltas", "drained"):
            raw[name] = tuple(tuple(pair) for pair in raw.get(name, ()))
        return Commit(**raw)

    def commit(self, new: Commit) -> Commit:
        """Write the commit after ``new.version``; fails when another run was faster."""
        new = replace(new, version=new.version + 1)
        self._mark_used(self.head(new.connector_id))
        text = json.dumps(asdict(new))
        self.files.write_new(self._commit_file(new.connector_id, new.version), text)
        self.files.write(self._head_note(new.connector_id), text)
        self._mark_used(new)
        return new

    def _used(self, connector_id: str, run_id: str) -> str:
        name = hashlib.sha256(run_id.encode()).hexdigest()
        return f"{self.root}/tables/{connector_id}/used/{name[:2]}/{name}"

    def _mark_used(self, commit: Commit) -> None:
        """Note the commit's run id. The next commit does it again, should a failure come between."""
        if commit.run_id and not self.files.exists(self._used(commit.connector_id, commit.run_id)):
            self.files.write(self._used(commit.connector_id, commit.run_id), commit.run_id)

    def committed(self, connector_id: str, run_id: str) -> bool:
        """Whether any commit of the connector was made by this run; one lookup however many there are."""
        return self.head(connector_id).run_id == run_id or self.files.exists(self._used(connector_id, run_id))

    def checkpoints(self) -> DataFrame:
        """``connector_id, watermark, updated_at`` of every connector, from the note of its last commit.

        A note is behind only after a failure between commit and note, until the connector's next run.
        """
        last = self._read_json(f"{self.root}/heads/*.json", _COMMIT_SCHEMA)
        return last.where("updated_at is not null").select("connector_id", "watermark", "updated_at")

    def _read_json(self, pattern: str, schema: str) -> DataFrame:
        if not self.files.any(pattern):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).json(pattern)

    # Record state and index table

    def delta_path(self, connector_id: str, run_id: str) -> str:
        return f"{self.root}/tables/{connector_id}/deltas/{run_id}"

    def staging(self, run_id: str) -> str:
        return f"{self.root}/staging/{run_id}"

    def read_documents(self, path: str) -> DataFrame:
        return self.spark.read.schema(DOC_SCHEMA).parquet(path)

    def _table(self, path: str | None, schema: str) -> DataFrame:
        if path is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def _folded(self, deltas: tuple[tuple[str, str], ...], fields: list[str]) -> DataFrame:
        """The last change per document over the deltas; in one delta a delete wins."""
        frames = [
            self.read_documents(path).select(
                "doc_id", "op", *fields, F.lit(run_id).alias("run_id"), F.lit(number).alias("number")
            )
            for number, (run_id, path) in enumerate(deltas)
        ]
        changes = reduce(DataFrame.unionByName, frames)
        if len(frames) == 1:
            gone = changes.where("op = 'DELETE'").select("doc_id")
            kept = changes.where("op <> 'DELETE'").join(gone, "doc_id", "left_anti")
            return kept.unionByName(changes.where("op = 'DELETE'"))
        place = F.struct("number", (F.col("op") == "DELETE").alias("dead"))
        last = changes.groupBy("doc_id").agg(F.max_by(F.struct("op", *fields, "run_id"), place).alias("c"))
        return last.select("doc_id", "c.*")

    def state_base(self, at: Commit, only: list[int] | None = None) -> DataFrame:
        """The state's base table, or some of its buckets."""
        if at.state_base and at.state_buckets:
            return read_buckets(self.spark, at.state_base, STATE_SCHEMA, at.state_buckets, only)
        return self._table(at.state_base, STATE_SCHEMA)

    def state_overlay(self, at: Commit) -> DataFrame | None:
        """The last change of each document since the base; None without any."""
        return self._folded(at.state_deltas, ["checksum", "updated_at"]) if at.state_deltas else None

    def state(self, connector_id: str, at: Commit | None = None) -> DataFrame:
        """Record state: base table without the touched keys, plus the last change of each."""
        at = at or self.head(connector_id)
        base, changes = self.state_base(at), self.state_overlay(at)
        if changes is None:
            return base
        fresh = changes.where("op <> 'DELETE'").select(
            F.lit(connector_id).alias("connector_id"),
            "doc_id",
            "checksum",
            F.col("updated_at").alias("source_updated_at"),
            F.col("run_id").alias("last_seen_run_id"),
        )
        if at.state_base is None:
            return fresh
        return base.join(changes.select("doc_id"), "doc_id", "left_anti").unionByName(fresh)

    def first_base(self, connector_id: str, run_id: str, keys: DataFrame, buckets: int) -> str:
        """The state after a first run, from its keys in buckets; returns the path."""
        rows = keys.select(
            F.lit(connector_id).alias("connector_id"),
            "doc_id",
            "checksum",
            F.col("updated_at").alias("source_updated_at"),
            F.lit(run_id).alias("last_seen_run_id"),
        )
        path = f"{self.root}/tables/{connector_id}/bases/first-{run_id}/state"
        write_buckets(rows, path, buckets, dealt=True)
        return path

    def digests_at(self, at: Commit) -> dict[int, Digest] | None:
        """The digests of the state's buckets, if the commit knows them."""
        if at.state_digests is None:
            return None
        return {int(bucket): tuple(digest) for bucket, digest in json.loads(self.files.read(at.state_digests)).items()}

    def note_digests(self, connector_id: str, run_id: str, found: dict[int, Digest]) -> str:
        path = f"{self.root}/tables/{connector_id}/digests/{run_id}.json"
        self.files.write(path, json.dumps(found))
        return path

    def _target_base(self, at: Commit, only: set[int] | None = None) -> DataFrame:
        """The index table's base, or some of its parts."""
        if at.target_parts is None:
            return self._table(at.target_base, TARGET_SCHEMA)
        folders = json.loads(self.files.read(at.target_parts))["folders"]
        paths = [folder for part, folder in folders.items() if only is None or int(part) in only]
        if not paths:
            return self.spark.createDataFrame([], TARGET_SCHEMA)
        return self.spark.read.schema(TARGET_SCHEMA).parquet(*paths)

    def _target_ids(self, at: Commit) -> DataFrame:
        """Index ids that the deltas touch, with the last ``op`` of each document; content is not read."""
        return self._folded(at.target_deltas, []).select(index_id(F.col("doc_id")).alias("id"), "op")

    def _applied(self, base: DataFrame, at: Commit) -> DataFrame:
        """The index table after its deltas, as ``apply_delta`` leaves it; only the fold moves content.

        Folded changes hold each document once, so an upsert stands against a delete only where the index ids of two
        documents are the same by chance. Those few ids are sent to all tasks; content would be shuffled again to meet them.
        """
        fields = ["title", "content", "uri", "mime_type", "updated_at", "acl_users", "acl_groups", "metadata", "checksum"]
        ids = self._target_ids(at)
        gone = ids.where("op = 'DELETE'").select("id")
        clash = ids.where("op <> 'DELETE'").select("id").join(gone, "id", "left_semi").distinct()
        incoming = index_envelope(self._folded(at.target_deltas, fields).where("op <> 'DELETE'"))
        added = incoming.join(F.broadcast(clash), "id", "left_anti")
        return base.join(ids.select("id"), "id", "left_anti").unionByName(added)

    def target(self, connector_id: str, at: Commit | None = None) -> DataFrame:
        """The index table: one envelope per live document."""
        at = at or self.head(connector_id)
        base = self._target_base(at)
        if not at.target_deltas:
            return base
        return self._applied(base, at)

    def compact(self, connector_id: str, state: bool = True, target: bool = False) -> Commit:
        """Fold deltas into the base tables and commit; of the target only the parts are written anew that deltas touch."""
        at = self.head(connector_id)
        place = f"{self.root}/tables/{connector_id}/bases/{at.version:012d}"
        if state and at.state_deltas:
            rows = self.state(connector_id, at)
            buckets = bucket_count(self.spark, rows.count())
            table = write_buckets(rows, f"{place}/state", buckets)
            at = replace(at, state_base=f"{place}/state", state_deltas=(), state_buckets=buckets)
            at = replace(at, state_digests=self.note_digests(connector_id, f"base-{at.version:012d}", digests(table, buckets)))
        if target and at.target_deltas:
            at = replace(at, target_parts=self._fold_target(at, f"{place}/target"), target_base=None, target_deltas=())
        return self.commit(replace(at, batch_id=None))

    def _fold_target(self, at: Commit, place: str) -> str:
        """Write the touched parts of the index table under a new folder; the note of where all parts lie points to old folders for the rest.

        The number of parts follows the table's size: it is set when the base is first written, and again, with all parts
        written anew, once parts have grown to four times what they were meant to be.
        """
        noted = json.loads(self.files.read(at.target_parts)) if at.target_parts else {"parts": 0, "folders": {}}
        size = sum(self.files.size(path) for _, path in at.target_deltas) + noted.get("bytes", 0)
        size += self.files.size(at.target_base) if at.target_base else 0
        parts, folders = noted["parts"], noted["folders"]
        if not parts or size > 4 * parts * self.part_bytes:
            parts, folders = max(1, -(-size // self.part_bytes)), {}
            rows = self.target(at.connector_id, at)
            touched = None
        else:
            ids = self._target_ids(at).select(self.part_of(parts, F.col("id")).alias("part")).distinct()
            touched = {row["part"] for row in ids.collect()}
            rows = self._applied(self._target_base(at, touched), at)
        dealt = rows.withColumn("part", self.part_of(parts, F.col("id"))).repartition("part")
        dealt.write.mode("overwrite").partitionBy("part").parquet(place)
        written = {name.removeprefix("part="): f"{place}/{name}" for name in self.files.names(place) if name.startswith("part=")}
        kept = {part: folder for part, folder in folders.items() if touched is not None and int(part) not in touched}
        note = f"{place}.json"
        self.files.write(note, json.dumps({"parts": parts, "bytes": sum(map(self.files.size, written.values())) + sum(map(self.files.size, kept.values())), "folders": kept | written}))
        return note

    @staticmethod
    def part_of(parts: int, column: Column) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(parts)).cast("int")

    # Run events

    def log(self, run_id: str, seq: int, **fields) -> None:
        """Append one run event as a small file."""
        event = {"run_id": run_id, "seq": seq, **fields}
        self.files.write(f"{self.root}/run_events/{run_id}-{seq}.json", json.dumps(event, default=_stamp))

    def run_events(self) -> DataFrame:
        """Events in files of their own, and those folded into tables."""
        fresh = self._read_json(f"{self.root}/run_events/*.json", _EVENT_SCHEMA)
        folded = f"{self.root}/run_events_folded"
        if not self.files.exists(folded):
            return fresh
        earlier = self.spark.read.schema(_EVENT_SCHEMA).option("recursiveFileLookup", True).parquet(folded)
        # A failure while folding can leave an event in both places.
        return fresh.unionByName(earlier).dropDuplicates(["run_id", "seq"])

    def fold_events(self) -> None:
        """Write the events of finished runs into one table and remove their small files."""
        names = [name for name in self.files.names(f"{self.root}/run_events") if name.endswith(".json")]
        done = {name[: -len("-1.json")] for name in names if name.endswith("-1.json")}
        paths = [f"{self.root}/run_events/{name}" for name in names if name.rsplit("-", 1)[0] in done]
        if not paths:
            return
        rows = self.spark.read.schema(_EVENT_SCHEMA).json(paths)
        rows.coalesce(1).write.parquet(f"{self.root}/run_events_folded/{uuid.uuid4().hex}")
        for path in paths:
            self.files.remove(path)

    def runs(self) -> DataFrame:
        """The run ledger, one row per run."""
        return fold_run_state(self.run_events())

    # Push queue

    def queue(self, table: str, schema: str) -> DataFrame:
        """A queue table with the stream and micro-batch that wrote each row, as partitions."""
        path = f"{self.root}/push/{table}"
        full = f"{schema}, stream string, batch_id bigint"
        if not self.files.exists(path):
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).parquet(path)

    def queue_at(self, table: str, schema: str, places) -> DataFrame:
        """The rows of a queue table that the given micro-batches (stream, number) have written; no other folder is looked at."""
        path = f"{self.root}/push/{table}"
        full = f"{schema}, stream string, batch_id bigint"
        paths = [f"{path}/stream={stream}/batch_id={batch_id}" for stream, batch_id in places]
        if not paths:
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).option("basePath", path).parquet(*paths)

    def add_batches(self, answered: DataFrame, part: str) -> None:
        """Write the push batches of a micro-batch, numbered in the order in which they came."""
        rows = answered.select(
            "run_id",
            "connector_id",
            F.col("key").alias("idempotency_key"),
            F.lit("PENDING").alias("status"),
            "accepted",
            "rejected",
            "created_at",
        )
        in_order = numbered(rows, [F.col("created_at"), F.col("run_id")], "pos")
        in_order.write.mode("overwrite").parquet(f"{self.root}/push/batches/{part}")

    def batches(self) -> DataFrame:
        """Push batches; those whose numbers the connectors' last commits name as drained are processed."""
        heads = self._read_json(f"{self.root}/heads/*.json", "connector_id string, drained array<array<string>>")
        ranges = heads.select("connector_id", F.explode("drained").alias("r")).select(
            "connector_id", F.col("r")[0].alias("stream"), F.col("r")[1].cast("bigint").alias("first"), F.col("r")[2].cast("bigint").alias("last")
        )
        found = self.queue("batches", BATCH_SCHEMA).withColumn("number", batch_number())
        done = found.join(ranges, ["connector_id", "stream"]).where("number BETWEEN first AND last").select("stream", "number", F.lit(True).alias("_done"))
        status = F.when(F.col("_done"), "PROCESSED").otherwise("PENDING")
        return found.join(done, ["stream", "number"], "left").withColumn("status", status).drop("_done", "number", "pos")

    def _open_places(self, at: Commit) -> list[tuple[str, int]]:
        """Finished micro-batches that the commit's ranges do not cover whole, by the names of their folders."""
        path = f"{self.root}/push/batches"
        places = []
        for folder in self.files.names(path):
            stream = folder.removeprefix("stream=")
            mine = [(first, last) for name, first, last in at.drained if name == stream]
            for name in self.files.names(f"{path}/{folder}"):
                if not name.startswith("batch_id="):
                    continue
                number = int(name.removeprefix("batch_id="))
                _, first, last = _whole(stream, number)
                covered = any(low <= first and last <= high for low, high in mine)
                if not covered and self.files.exists(f"{path}/{folder}/{name}/_SUCCESS"):
                    places.append((stream, number))
        return places

    def waiting(self, at: Commit) -> Waiting:
        """What waits for a connector. Only folders that its ranges do not cover are read, however many commits were made."""
        places = self._open_places(at)
        rows = self.queue_at("batches", BATCH_SCHEMA, places).where(F.col("connector_id") == at.connector_id)
        rows = rows.withColumn("number", batch_number())
        open_ = {stream for stream, _ in places}
        ranges = [one for one in at.drained if one[0] in open_]
        if ranges:
            done = self.spark.createDataFrame(ranges, "_stream string, _first bigint, _last bigint")
            inside = (F.col("stream") == F.col("_stream")) & F.col("number").between(F.col("_first"), F.col("_last"))
            rows = rows.join(F.broadcast(done), inside, "left_anti")
        return Waiting(rows.withColumn("status", F.lit("PENDING")), tuple(places))

    @staticmethod
    def drained_with(at: Commit, waiting: Waiting, taken: DataFrame | None) -> tuple[tuple[str, int, int], ...]:
        """The commit's ranges once the ``taken`` batches are done, or all that wait where none are named.

        Ranges go as far as the next batch that waits, and over whole micro-batches without one, so they stay few.
        """
        if taken is None:
            return merged_ranges([*at.drained, *(_whole(*place) for place in waiting.places)])
        mine = taken.select("stream", F.col("batch_id").alias("_batch"), F.col("number").alias("_taken"))
        left = waiting.batches.join(taken.select("stream", "number"), ["stream", "number"], "left_anti")
        busy = {(row["stream"], row["batch_id"]) for row in left.select("stream", "batch_id").distinct().collect()}
        ranges = [_whole(*place) for place in waiting.places if place not in busy]
        beside = left.withColumnRenamed("stream", "_stream")
        near = mine.join(beside, (F.col("stream") == F.col("_stream")) & (F.col("batch_id") == F.col("_batch")))
        bounds = near.groupBy("stream", "_batch", "_taken").agg(
            F.max(F.when(F.col("number") < F.col("_taken"), F.col("number"))).alias("low"),
            F.min(F.when(F.col("number") > F.col("_taken"), F.col("number"))).alias("high"),
        )
        for row in bounds.collect():
            _, first, last = _whole(row["stream"], row["_batch"])
            ranges.append((row["stream"], first if row["low"] is None else row["low"] + 1, last if row["high"] is None else row["high"] - 1))
        return merged_ranges([*at.drained, *ranges])

    def queue_events(self) -> DataFrame:
        return self.queue("events", QUEUE_EVENT_SCHEMA)

    def keys(self) -> DataFrame:
        return self.queue("keys", KEY_SCHEMA)


def _stamp(value):
    if isinstance(value, datetime):
        return value.astimezone(timezone.utc).isoformat() if value.tzinfo else value.isoformat() + "+00:00"
    raise TypeError(type(value))
