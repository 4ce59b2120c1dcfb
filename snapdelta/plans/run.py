"""One run of a connector, from extraction to commit."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from snapdelta.functions.template import _SLOT
from snapdelta.functions.text import field_type, has_field, mark_text, ref
from snapdelta.operators.diff import changed_against, delta_of
from snapdelta.operators.gates import GateError, flag_unsafe, require_unique, split_ops
from snapdelta.operators.normalize import DOC_COLUMNS, normalize
from snapdelta.operators.queue import next_pending_batch
from snapdelta.plans.buckets import EMPTY, bucket_count, bucket_of, differing, digest_columns, forget_buckets, moved, read_buckets, write_buckets
from snapdelta.plans.publish import Manifest, publish, publish_csv
from snapdelta.plans.store import QUEUE_EVENT_SCHEMA, Commit, Store, settle
from snapdelta.sources.csvfiles import csv_pull, file_listing, file_mark, matched_files
from snapdelta.sources.pages import PageChainError, item_rows, json_pages, link_gaps, page_chain, page_links, read_pages
from snapdelta.sources.sql import high_water_mark, jdbc_pull, sql_pull
from snapdelta.spec import LAKE, Connector

COMPACT_EVERY = 16
FOLD_EVERY = 64

# A step that brings a published delta into an outside index; failing stops the commit.
IndexStep = Callable[[Manifest, DataFrame, DataFrame], None]


class SourceChanged(RuntimeError):
    """The source gave other rows on the second read of a run."""


@dataclass(frozen=True)
class RunResult:
    run_id: str
    connector_id: str
    upserts: int
    deletes: int
    manifest_path: str | None


def _now() -> datetime:
    return datetime.now(tz=timezone.utc)


def _template_fields(connector: Connector) -> list[str]:
    mapping = connector.mapping
    names = [mapping.id_field, mapping.title_field]
    for template in (mapping.content_template, mapping.uri_template or ""):
        names += _SLOT.findall(template)
    return list(dict.fromkeys(names))


def _page_rows(store: Store, connector: Connector, run_id: str) -> DataFrame:
    source, mapping = connector.source, connector.mapping
    pages = read_pages(store.spark, source.path)
    if source.next_cursor_path:
        pages = _chained_pages(store, pages, source, run_id)
    items = json_pages(pages)
    needed = _template_fields(connector)
    lists = [name for name in (mapping.acl_users_field, mapping.acl_groups_field) if name]
    scalars = dict.fromkeys([*needed, *filter(None, [source.watermark_field])])
    return item_rows(items, [name for name in scalars if name not in lists], lists, needed, facts=mapping.metadata_fields)


def _first_page(links: DataFrame) -> str:
    """The page that begins the chain: the only one that no page names.

    Of several such pages each may be left over from an earlier pull or stand behind a hole, and files do not tell which;
    then the spec has to name the first one.
    """
    named = links.select(F.col("next_cursor").alias("cursor"))
    begins = [row["cursor"] for row in links.join(named, "cursor", "left_anti").orderBy("cursor").limit(4).collect()]
    if not begins:
        raise GateError("the pages form a cycle: every page is named by another")
    if len(begins) > 1:
        raise GateError("no page names these, and firstPage does not say which begins the chain: " + ", ".join(begins))
    return begins[0]


def _chained_pages(store: Store, pages: DataFrame, source, run_id: str) -> DataFrame:
    """The pages of the chain. Stops the run when it has a hole, which would pass for deleted documents, or comes back to itself.

    The file of a page is named by the cursor that fetched it, URL-encoded, whatever its extension; the first may have
    any name. Pages that the chain does not reach are listed in a report and left out.
    """
    # The path is a URI, so the name in it is escaped once more.
    file = F.url_decode(F.replace(F.element_at(F.split("page", "/"), -1), F.lit("+"), F.lit("%2B")))
    named = pages.withColumn("cursor", F.url_decode(F.regexp_replace(file, r"\.[^.]*$", "")))
    bodies = page_links(named, source.next_cursor_path, keep=("page",))
    links = settle(bodies, f"{store.staging(run_id)}/links")
    if links.isEmpty():
        return pages
    try:
        chain = page_chain(links, source.first_page or _first_page(links))
    except PageChainError as error:
        raise GateError(str(error)) from error
    report = f"{store.root}/reports/{run_id}"
    gaps = settle(link_gaps(links).join(chain, "cursor").select("cursor", "next_cursor", "place"), f"{store.staging(run_id)}/gaps")
    missing = gaps.orderBy("place").limit(3).collect()
    if missing:
        many = gaps.count()
        more = f" and {many - len(missing)} more" if many > len(missing) else ""
        raise GateError("pages are missing: " + ", ".join(f"{r['next_cursor']} after {r['cursor']}" for r in missing) + more)
    left = links.join(chain, "cursor", "left_anti").select("cursor", "page")
    left.write.mode("overwrite").json(f"{report}/leftover_pages")
    left = store.spark.read.schema(left.schema).json(f"{report}/leftover_pages")
    return pages if left.isEmpty() else pages.join(left.select("page"), "page", "left_anti")


def _extract(
    store: Store, connector: Connector, mark: str | None, run_id: str, connection: dict[str, str] | None
) -> tuple[DataFrame, DataFrame | None]:
    """Source rows, and for files the listing that was taken before they were read.

    Rows of an outside database are written first, since a run reads them twice.
    """
    spark, source = store.spark, connector.source
    if connector.mode == "sql_pull":
        if source.type == LAKE:
            return sql_pull(spark, source.query, mark)[0], None
        if connection is None:
            raise ValueError("a database source needs connection options")
        staged = f"{store.staging(run_id)}/rows"
        ranges = {}
        if source.partition_column:
            ranges = {"partition_column": source.partition_column, "bounds": source.bounds, "partitions": source.partitions}
        jdbc_pull(spark, connection, source.query, mark, dialect=source.type, **ranges)[0].write.mode("overwrite").parquet(staged)
        return spark.read.parquet(staged), None
    if connector.mode == "rest_pull":
        return _page_rows(store, connector, run_id), None
    paths = matched_files(spark, source.path, source.glob)
    files = settle(file_listing(spark, paths=paths), f"{store.staging(run_id)}/files")
    return csv_pull(spark, source.path, source.glob, source.csv, paths), files


def _new_mark(files: DataFrame | None, rows_mark: str | None, previous: str | None) -> str | None:
    """The mark to commit, from the greatest mark among the rows of this run and the files they came from."""
    if files is not None:
        return file_mark(files, rows_mark, previous)
    return previous if rows_mark is None else rows_mark


def _mark_column(rows: DataFrame, field: str | None):
    if not field or not has_field(rows, field):
        return F.lit(None).cast("string")
    return mark_text(ref(field), field_type(rows, field))


@dataclass(frozen=True)
class _Pulled:
    """What a pull has written: the delta, its counts, the greatest mark of the rows, and the state tables for the commit."""

    path: str
    upserts: int
    deletes: int
    mark: str | None
    state: dict


def _pull_delta(
    store: Store, connector: Connector, rows: DataFrame, at: Commit, run_id: str, run_ts: datetime
) -> _Pulled:
    """Write the delta of a pull.

    First pass over the source: id, checksum, unsafe flag and mark of every row, written narrow and in the state's buckets.
    The gates, the mark and the diff read that table only, and none of them moves a row again. Buckets with the digests
    of the state are not compared at all. Second pass: documents of changed ids, which
    is where content is kept. So content is read twice but neither shuffled nor cached.
    """
    spark, mapping, name = store.spark, connector.mapping, connector.name
    field = connector.source.watermark_field
    staged = store.staging(run_id)
    marked = rows.withColumn("_mark", _mark_column(rows, field))
    documents = flag_unsafe(normalize(marked, mapping, name, field, run_ts, keep=("_mark",)))
    narrow, buckets = documents.select("doc_id", "checksum", "updated_at", "unsafe", "_mark"), at.state_buckets
    if not buckets:
        # The number of buckets follows the number of rows, which only a pass over the source tells.
        narrow = settle(narrow, f"{staged}/first")
        buckets = bucket_count(spark, narrow.count())
    keys = write_buckets(narrow, f"{staged}/keys", buckets)
    found = keys.groupBy(bucket_of(buckets).alias("bucket")).agg(
        F.count_if("unsafe").alias("unsafe"), F.max("_mark").alias("mark"), *digest_columns()
    ).collect()
    if any(row["unsafe"] for row in found):
        raise GateError("unsafe marker detected in document content")
    require_unique(keys, report=f"{store.root}/reports/{run_id}/duplicate_ids")
    now = {row["bucket"]: (row["rows"], row["first"], row["second"]) for row in found}
    total, path = sum(rows for rows, _, _ in now.values()), store.delta_path(name, run_id)
    mark = max((row["mark"] for row in found if row["mark"] is not None), default=None)

    if at.state_base is None and not at.state_deltas:
        # Nothing is known yet: every row is new, no content needs to meet a list of changed ids, and the keys are the state.
        delta, expected = normalize(rows, mapping, name, field, run_ts), moved({}, {}, now)
        come, gone = total, 0
        state = {"state_base": store.first_base(name, run_id, keys, buckets), "state_buckets": buckets, "state_deltas": (), "state_digests": store.note_digests(name, run_id, now)}
    else:
        known = store.digests_at(at)
        only = None if known is None else differing(known, now)
        changes = settle(_changes(store, connector, keys, at, buckets, only, staged), f"{staged}/changes")
        facts = changes.groupBy("change", bucket_of(buckets).alias("bucket")).agg(
            F.struct(*digest_columns("doc_id", "old_sum")).alias("old"), F.struct(*digest_columns("doc_id", "now_sum")).alias("now"), F.count(F.lit(1)).alias("n")
        ).collect()
        _check_delete_ratio(store, connector, sum(row["n"] for row in facts if row["change"] == "missing"), at)
        come = sum(row["n"] for row in facts if row["change"] != "missing")
        gone = sum(row["n"] for row in facts if row["change"] == "missing")
        delta = delta_of(rows, changes, mapping, name, field, connector.delete_policy, run_ts)
        expected, before = _summed(facts, "now"), _summed(facts, "old")
        state = {"state_deltas": at.state_deltas + ((run_id, path),), "state_digests": None}
        if known is not None:
            state["state_digests"] = store.note_digests(name, run_id, moved(known, before, expected))
    _write_delta(delta, path, come, gone, expected)
    forget_buckets(spark, f"{staged}/keys")
    return _Pulled(path, come, gone, mark, state)


def _changes(store: Store, connector: Connector, keys: DataFrame, at: Commit, buckets: int, only: list[int] | None, staged: str) -> DataFrame:
    """Keys that differ from the state, looked for in the buckets whose digests differ."""
    base, overlay = store.state_base(at, only), store.state_overlay(at)
    if not at.state_buckets:
        base, overlay = store.state(connector.name, at), None
    if only is not None:
        keys = read_buckets(store.spark, f"{staged}/keys", keys.schema, buckets, only)
        overlay = overlay if overlay is None else overlay.where(bucket_of(buckets).isin(only))
    return changed_against(keys, base, overlay, connector.delete_policy)


def _summed(facts: list, side: str) -> dict[int, tuple[int, int, int]]:
    """Digests by bucket of one side of the changes."""
    total: dict[int, tuple[int, int, int]] = {}
    for row in facts:
        total = moved(total, {}, {row["bucket"]: (row[side]["rows"], row[side]["first"], row[side]["second"])})
    return total


def _write_delta(delta: DataFrame, path: str, come: int, gone: int, expected: dict[int, tuple[int, int, int]]) -> None:
    """Write the delta, and fail unless its documents are those that the gates have seen: as many, with the same ids and checksums.

    The rows are counted and their digest is taken on their way into the files.
    """
    live = F.when(F.col("op") != "DELETE", F.col("checksum"))
    seen = Observation()
    columns = digest_columns("doc_id", "_live")
    watched = delta.withColumn("_live", live).observe(seen, *columns, F.count_if(F.col("op") == "DELETE").alias("gone"))
    watched.drop("_live").write.mode("overwrite").partitionBy("op").parquet(path)
    written = seen.get
    whole = EMPTY
    for digest in expected.values():
        whole = moved({0: whole}, {}, {0: digest}).get(0, EMPTY)
    if written["rows"] != come or written["gone"] != gone:
        raise SourceChanged(f"{written['rows']} documents and {written['gone']} deletes written for {come} and {gone} changed ids")
    if (written["rows"], written["first"], written["second"]) != whole:
        raise SourceChanged("documents differ from what the gates have checked")


def _check_delete_ratio(store: Store, connector: Connector, gone: int, at: Commit) -> None:
    """Optional guard against an empty or partial snapshot deleting everything."""
    if connector.max_delete_ratio is None or not gone:
        return
    known = store.state(connector.name, at).count()
    if gone / known > connector.max_delete_ratio:
        raise GateError(f"{gone} of {known} documents would be deleted")


def _push_delta(store: Store, connector: Connector, run_id: str, batches: DataFrame) -> str:
    """Write the documents of waiting batches as one delta. They are not compared with the state.

    Batches count in the order in which they came: the last that names a document decides, with its last upsert and its
    delete, of which the delete wins. So one delta of many batches leaves what one delta each would. Ids and places decide;
    the events that lose are listed, and all others are read once more, without a shuffle of content while few lose.
    """
    places = [(row["stream"], row["batch_id"]) for row in batches.select("stream", "batch_id").distinct().collect()]
    order = batches.select("run_id", F.struct("created_at", "run_id").alias("batch"))
    events = store.queue_at("events", QUEUE_EVENT_SCHEMA, places).where(F.col("connector_id") == connector.name)
    narrow = events.select("run_id", "pos", "doc_id", "op").join(order, "run_id")
    narrow = settle(narrow, f"{store.staging(run_id)}/events")
    place = F.struct("batch", "pos")
    last = narrow.groupBy("doc_id").agg(
        F.max("batch").alias("decides"),
        F.max(F.when(F.col("op") == "DELETE", place)).alias("gone"),
        F.max(F.when(F.col("op") != "DELETE", place)).alias("kept"),
    )
    winners = last.select("decides", F.explode(F.array("gone", "kept")).alias("w")).where("w.batch = decides")
    winners = winners.select(F.col("w.batch.run_id").alias("run_id"), F.col("w.pos").alias("pos"))
    losers = settle(narrow.select("run_id", "pos").join(winners, ["run_id", "pos"], "left_anti"), f"{store.staging(run_id)}/losers")
    documents = events.join(order.select("run_id"), "run_id", "left_semi").join(losers, ["run_id", "pos"], "left_anti")
    path = store.delta_path(connector.name, run_id)
    documents.select(*DOC_COLUMNS).write.mode("overwrite").partitionBy("op").parquet(path)
    return path


def run_connector(
    store: Store,
    connector: Connector,
    run_id: str,
    run_ts: datetime | None = None,
    push_run_id: str | None = None,
    connection: dict[str, str] | None = None,
    index_step: IndexStep | None = None,
    clock: Callable[[], datetime] = _now,
    all_waiting: bool = False,
) -> RunResult:
    """Extract, normalize, check, diff, publish, index and commit.

    Any failure leaves the last commit in force: mark, state and queue stay as they were, and the
    run is logged as failed. A push run drains the oldest waiting batch, the one named, or with
    ``all_waiting`` every batch that waits. A failed run's files are not named by any commit, and the same run id
    may be tried again; the id of a committed run may not, since its files are in force.
    """
    if store.committed(connector.name, run_id):
        raise ValueError(f"run {run_id} has been committed already")
    started = run_ts or clock()
    facts = {"connector_id": connector.name, "started_at": started}
    store.log(run_id, 0, status="RUNNING", **facts)
    try:
        result = _run(store, connector, run_id, started, push_run_id, connection, index_step, clock, all_waiting)
    except Exception as error:
        store.log(
            run_id,
            1,
            status="FAILED",
            finished_at=clock(),
            error_class=type(error).__name__,
            error_message=str(error),
            **facts,
        )
        raise
    store.log(
        run_id,
        1,
        status="SUCCESS",
        finished_at=clock(),
        upserts_count=result.upserts,
        deletes_count=result.deletes,
        manifest_path=result.manifest_path,
        **facts,
    )
    store.files.remove(store.staging(run_id))
    last = store.head(connector.name)
    if last.version % FOLD_EVERY == 0:
        store.fold_events()
    if len(last.state_deltas) >= COMPACT_EVERY or len(last.target_deltas) >= COMPACT_EVERY:
        store.compact(connector.name, len(last.state_deltas) >= COMPACT_EVERY, len(last.target_deltas) >= COMPACT_EVERY)
    return result


def _run(store, connector, run_id, run_ts, push_run_id, connection, index_step, clock, all_waiting) -> RunResult:
    at = store.head(connector.name)
    batch_id = None
    drained = at.drained
    if connector.mode == "rest_push":
        waiting = store.waiting(at)
        named = waiting.batches if all_waiting else next_pending_batch(waiting.batches, push_run_id)
        columns = ("run_id", "stream", "batch_id", "created_at", "number")
        batches = settle(named.select(*columns), f"{store.staging(run_id)}/batches")
        found = batches.limit(2).collect()
        if not found:
            return RunResult(run_id, connector.name, 0, 0, None)
        if len(found) == 1:
            batch_id = found[0]["run_id"]
        drained = store.drained_with(at, waiting, None if all_waiting else batches)
        path, mark = _push_delta(store, connector, run_id, batches), at.watermark
        # What a pushed document replaces is not looked up, so the digests are not known until the next compaction.
        state, counts = {"state_deltas": at.state_deltas + ((run_id, path),), "state_digests": None}, None
    else:
        rows, files = _extract(store, connector, at.watermark, run_id, connection)
        if connector.output.format == "csv":
            return _export(store, connector, rows, at, run_id, run_ts, clock)
        pulled = _pull_delta(store, connector, rows, at, run_id, run_ts)
        path, state, counts = pulled.path, pulled.state, (pulled.upserts, pulled.deletes)
        mark = _new_mark(files, pulled.mark, at.watermark)

    delta = store.read_documents(path)
    manifest = publish(delta, connector.output, connector.name, run_id, mark, run_ts, clock(), counts)
    if connector.index and index_step:
        index_step(manifest, *split_ops(delta))

    link = (run_id, path)
    store.commit(
        replace(
            at,
            run_id=run_id,
            watermark=mark,
            updated_at=clock().isoformat(),
            batch_id=batch_id,
            drained=drained,
            **state,
            target_deltas=at.target_deltas + ((link,) if connector.index else ()),
        )
    )
    return RunResult(run_id, connector.name, manifest.upserts_count, manifest.deletes_count, manifest.manifest_path)


def _export(store, connector, rows, at, run_id, run_ts, clock) -> RunResult:
    """CSV snapshot: no mapping, no diff and no state, but the mark moves on.

    The rows are written once; mark, count, rows and alias are taken from there.
    """
    rows = settle(rows, f"{store.staging(run_id)}/export")
    mark = high_water_mark(rows, connector.source.watermark_field, at.watermark).first()["watermark"]
    manifest = publish_csv(rows, connector.output, connector.name, run_id, mark, run_ts, clock())
    store.commit(replace(at, run_id=run_id, watermark=mark, updated_at=clock().isoformat(), batch_id=None))
    return RunResult(run_id, connector.name, manifest.upserts_count, 0, manifest.manifest_path)
