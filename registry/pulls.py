"""Sources, publishing, whole runs and streams; files are written from the test tables first."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections import defaultdict
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from registry.bindings import (
    DOC_MAPPING,
    SQL_DOCS,
    SQL_RUNS,
    document_rows,
    run_delta,
    runs_of,
    shown_docs,
    sql_delta,
    sql_shown,
    sql_tree_digest,
    table,
)
from registry.ledger import shown
from snapdelta.functions.digest import WIDTHS
from snapdelta.functions.text import iso_text
from snapdelta.plans.publish import publish, publish_csv, union_rows
from snapdelta.plans.run import run_connector
from snapdelta.plans.store import Store
from snapdelta.session import scratch, setting, settled
from snapdelta.sources.artifacts import read_delta
from snapdelta.sources.csvfiles import CsvOptions, clean_errors, csv_pull, file_checkpoint, file_listing, file_manifest_hash
from snapdelta.sources.pages import json_pages, missing_fields, page_chain, page_gaps, page_links, project_items
from snapdelta.sources.sql import high_water_mark, sql_pull
from snapdelta.spec import Connector, Output, Source
from snapdelta.streaming.drain import drain_together
from snapdelta.streaming.intake import REQUEST_SCHEMA, intake_stream
from snapdelta.streaming.status import status_chart, status_stream

AT = datetime(2024, 2, 1, tzinfo=timezone.utc)
MARK = "1998-01-01T00:00:00+00:00"


def _view(df, name):
    """A table name of the session for a frame."""
    view = f"{name}_{uuid.uuid4().hex[:8]}"
    df.createOrReplaceTempView(view)
    return view


# SQL pulls


def sql_pull_watermark(spark, d):
    view = _view(table(spark, d, "orders"), "orders")
    query = f"SELECT o_orderkey, o_orderstatus FROM {view} WHERE o_orderdate > CAST(:watermark AS TIMESTAMP)"
    return sql_pull(spark, query, MARK, "o_orderdate")[0]


def sql_pull_mark(spark, d):
    view = _view(table(spark, d, "orders"), "orders")
    query = f"SELECT o_orderkey, o_orderdate FROM {view} WHERE o_orderdate > CAST(:watermark AS TIMESTAMP)"
    return sql_pull(spark, query, MARK, "o_orderdate")[1]


def _marks(spark, d):
    """Marks of time, number and text columns, of an absent column and of no rows."""
    orders = table(spark, d, "orders")
    wanted = {"o_orderdate": orders, "o_orderkey": orders, "o_orderpriority": orders, "absent": orders,
              "o_orderstatus": orders.where("o_orderkey < 0")}
    rows = [high_water_mark(df, name, "before").select(F.lit(name).alias("field"), "watermark") for name, df in wanted.items()]
    return union_rows(rows)


def _cleaned(spark, d):
    events = table(spark, d, "events")
    cell = F.when(F.col("event_type") == "error", F.concat(F.lit("#ERROR ('"), "props", F.lit("')"))).when(
        F.col("event_type") == "view", F.lit("#ERRORS kept")
    )
    return clean_errors(events.select("event_id", F.coalesce(cell, "props").alias("cell"), "event_type"))


# CSV directories


def pieces(total, each):
    """Number of parts of about ``each`` that ``total`` makes, at least one."""
    return max(1, -(-total // each))


# Orders in one written file at most: a file is read or sorted by one task.
_FILE_ORDERS, _FILE_LINES = 50_000, 500_000


def _orders_as_csv(spark, d, files=3, **options):
    """Two folders of order files whose headers differ in order and in columns."""
    base = scratch(spark, "csv")
    orders = table(spark, d, "orders").withColumn(
        "Order Note/Text",
        F.when(F.col("o_orderkey") % 4 == 0, F.lit("#ERROR in cell"))
        .when(F.col("o_orderkey") % 4 == 1, F.lit(""))
        .otherwise(F.concat(F.lit('line "one"\nand; '), "o_orderpriority")),
    )
    first = orders.where("o_orderkey % 2 = 0").select("o_orderkey", "o_orderstatus", "Order Note/Text")
    second = orders.where("o_orderkey % 2 = 1").select("Order Note/Text", "o_orderkey")
    for name, frame in (("a", first), ("b", second)):
        writer = frame.repartition(files, "o_orderkey").write.option("header", options.get("header", True))
        writer.option("escape", '"').option("sep", ";").option("quoteAll", True).csv(f"{base}/{name}")
    return base


def _orders_as_lines(spark, d, header, most=_FILE_LINES):
    """Files of ``most`` orders or so, in the order of their keys: cells with quotes inside, quoted line breaks, short rows and blank lines."""
    base = scratch(spark, "csv")
    key = F.col("o_orderkey").cast("string")
    line = (
        F.when(F.col("o_orderkey") % 5 == 0, F.concat(key, F.lit(',a"b,c"d')))
        .when(F.col("o_orderkey") % 5 == 1, F.concat(key, F.lit(',"first\n""second"",\n\nlast"x,'), "o_orderpriority"))
        .when(F.col("o_orderkey") % 5 == 2, F.concat(key, F.lit(",only")))
        .when(F.col("o_orderkey") % 5 == 3, F.concat(F.lit('"'), key, F.lit('","",""')))
        .otherwise(F.concat(key, F.lit(",x,"), "o_orderpriority"))
    )
    orders, head = table(spark, d, "orders"), 'id,"the\nnote",priority'
    lines, many = orders.select(F.col("o_orderkey").alias("n"), line.alias("value")), orders.count()
    lines = lines.repartitionByRange(pieces(many, most), "n").sortWithinPartitions("n").select("value")

    def headed(batches):
        yield pa.RecordBatch.from_arrays([pa.array([head])], ["value"])
        yield from batches

    if header:  # no rows may be no task
        lines = lines.mapInArrow(headed, "value string") if many else spark.range(1).select(F.lit(head).alias("value"))
    lines.write.text(base)
    return base


def _divided(spark, base, **options):
    """A pull in ranges of 64 KB, so that records go over their ends."""
    with setting(spark, "spark.sql.files.maxPartitionBytes", "64k"), setting(spark, "spark.sql.files.openCostInBytes", "1"):
        return csv_pull(spark, base, "*.txt", CsvOptions(**options))


def csv_ranges(spark, d):
    rows = _divided(spark, _orders_as_lines(spark, d, True))
    return rows.select("id", F.col("the\nnote").alias("note"), "priority")


def csv_ranges_no_header(spark, d):
    return _divided(spark, _orders_as_lines(spark, d, False), has_header=False).select("column_1", "column_2", "column_3")


def csv_pull_row(spark, d):
    base = _orders_as_csv(spark, d)
    rows = csv_pull(spark, base, "*/*.csv", CsvOptions(delimiter=";", normalize_headers=True, clean_errors=True))
    folder = F.element_at(F.split("file_path", "/"), -2)
    return rows.select("o_orderkey", "o_orderstatus", "order_note_text", folder.alias("folder"))


def csv_pull_no_header(spark, d):
    base = _orders_as_csv(spark, d, header=False)
    rows = csv_pull(spark, base, "*/*.csv", CsvOptions(delimiter=";", has_header=False))
    folder = F.element_at(F.split("file_path", "/"), -2)
    data = [name for name in rows.columns if name.startswith("column_")]
    return rows.select(*data, folder.alias("folder"))


def csv_pull_file(spark, d):
    """Rows found again inside the one record of each file."""
    base = _orders_as_csv(spark, d, files=max(3, pieces(table(spark, d, "orders").count(), 2 * _FILE_ORDERS)))
    files = csv_pull(spark, base, "*/*.csv", CsvOptions(document_mode="file", delimiter=";"))
    rows = files.select(F.explode(F.from_json("file_rows_json", "array<map<string,string>>")).alias("r"))
    return rows.select(
        F.col("r")["o_orderkey"].alias("o_orderkey"),
        F.col("r")["o_orderstatus"].alias("o_orderstatus"),
        F.col("r")["Order Note/Text"].alias("note"),
    )


def plain_tree_digest(lines):
    """``functions.digest.tree_digest`` of different lines, by hand."""

    def digest(text):
        return hashlib.sha256(text.encode()).hexdigest()

    nodes = sorted(f"{digest(line)}:1" for line in lines)
    for width in WIDTHS:
        groups = defaultdict(list)
        for item in nodes:
            groups[item[:width]].append(item)
        nodes = sorted(f"{name}:{digest(','.join(items))}" for name, items in groups.items())
    return digest(",".join(nodes))


def _file_checkpoint(spark, d):
    base = _orders_as_csv(spark, d)
    rows = csv_pull(spark, base, "*/*.csv", CsvOptions(delimiter=";"))
    files = file_listing(spark, base, "*/*.csv")
    text = file_checkpoint(files, rows, "o_orderkey", None)
    # Paths and times differ from run to run; they are compared with a plain reading of the same listing.
    listed = sorted((r["path"], r["mtime"], r["size"]) for r in files.collect())
    lines = [json.dumps({"mtime": m, "path": p, "size": n}, separators=(",", ":")) for p, m, n in listed]
    stored = spark.range(1).select(F.parse_json(F.lit(text)).alias("c"))
    return stored.select(
        F.variant_get("c", "$.v", "int").alias("v"),
        F.variant_get("c", "$.rw", "string").alias("rw"),
        F.variant_get("c", "$.fc", "int").alias("fc"),
        (F.variant_get("c", "$.fh", "string") == f"sha256:{plain_tree_digest(lines)}").alias("hashed"),
        (F.variant_get("c", "$.lm", "string") == max(m for _, m, _ in listed)).alias("latest"),
    )


def file_manifest(spark, d):
    """Manifest hash of a listing with one file per document."""
    listing = table(spark, d, "documents").select(
        F.concat(F.lit("/in/"), "source", F.lit("/"), "doc_id", F.lit(".csv")).alias("path"),
        iso_text(F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id"))).alias("mtime"),
        F.col("n_chars").alias("size"),
    )
    return file_manifest_hash(listing)


# JSON pages

_PAGE_ROWS = 100


def _pages(spark, d):
    """Orders in pages of a hundred: with items, as bare lists, with strays and without items."""
    number = F.floor(F.col("o_orderkey") / _PAGE_ROWS)
    item = F.to_json(F.struct("o_orderkey", "o_orderstatus", "o_totalprice"))
    grouped = table(spark, d, "orders").groupBy(number.alias("n")).agg(
        F.array_join(F.array_sort(F.collect_list(item)), ",").alias("items")
    )
    following = F.concat(F.lit('{"next":{"cursor":"p'), F.col("n") + 1, F.lit('"}}'))
    body = (
        F.when(F.col("n") % 5 == 1, F.concat(F.lit('[7, null, "x",'), "items", F.lit("]")))
        .when(F.col("n") % 5 == 2, F.lit('{"paging":null}'))
        .otherwise(F.concat(F.lit('{"items":['), "items", F.lit('],"paging":'), following, F.lit("}")))
    )
    cursor = F.concat(F.lit("p"), "n")
    return grouped.select("n", F.concat(F.lit("page "), "n").alias("page"), cursor.alias("cursor"), body.alias("body"))


def _page_items(spark, d):
    items = json_pages(_pages(spark, d))
    fields = {"o_orderkey": "bigint", "o_orderstatus": "string", "absent": "string"}
    return project_items(items, fields, keep=("page",))


def _missing_fields(spark, d):
    """Items that lack an id or a title, counted by field; null values are there."""
    item = F.concat(
        F.lit("{"),
        F.concat_ws(
            ",",
            F.when(F.col("o_orderkey") % 11 != 0, F.concat(F.lit('"id":'), "o_orderkey")),
            F.when(F.col("o_orderkey") % 7 != 0, F.concat(F.lit('"title":"'), "o_orderstatus", F.lit('"'))),
            F.when(F.col("o_orderkey") % 5 != 0, F.lit('"note":null')),
        ),
        F.lit("}"),
    )
    pages = table(spark, d, "orders").groupBy(F.floor(F.col("o_orderkey") / _PAGE_ROWS).alias("n")).agg(F.array_join(F.collect_list(item), ",").alias("items"))
    pages = pages.select(F.col("n").cast("string").alias("page"), F.concat(F.lit("["), "items", F.lit("]")).alias("body"))
    return missing_fields(json_pages(pages), ["id", "title", "note"])


def _page_gaps(spark, d):
    return page_gaps(_pages(spark, d).where("n % 7 <> 4"), "paging.next.cursor")


def _linked_pages(spark, d):
    """The same pages as one chain in their order, but for every seventh: one half of those names pages of the chain, the other forms a cycle."""
    numbers = table(spark, d, "orders").select(F.floor(F.col("o_orderkey") / _PAGE_ROWS).alias("n")).distinct()
    kind = F.when(F.col("n") % 7 != 4, 0).when(F.col("n") % 2 == 0, 1).otherwise(2)
    kinds = numbers.withColumn("kind", kind)
    along = Window.partitionBy("kind").orderBy("n")
    ends = F.when(F.col("kind") == 2, F.min("n").over(Window.partitionBy("kind")))
    on = kinds.withColumn("on", F.when(F.col("kind") == 1, F.col("n") + 1).otherwise(F.coalesce(F.lead("n").over(along), ends)))
    following = F.when(F.col("on").isNull(), F.lit('{"items":[]}')).otherwise(F.concat(F.lit('{"next":"p'), "on", F.lit('"}')))
    return on.select(F.concat(F.lit("p"), "n").alias("cursor"), following.alias("body"))


def _page_chain(spark, d):
    """Every page's place in the chain; null for those that it does not reach."""
    links = settled(page_links(_linked_pages(spark, d), "next"), "links")
    number = F.expr("cast(substring(cursor, 2) as bigint)")
    first = links.where(number % 7 != 4).select(F.min_by("cursor", number)).first()[0]
    return links.select("cursor").join(page_chain(links, first), "cursor", "left")


# Publishing


def _delta(spark, d):
    return settled(run_delta(spark, d), "delta")


def _published(spark, d, alias=False):
    output = Output(scratch(spark, "out"), publish_latest_alias=alias)
    return publish(_delta(spark, d), output, "docs", "run-1", "m1", AT, AT)


def read_published(spark, d):
    manifest = _published(spark, d)
    docs = read_delta(spark, manifest.upserts_path).unionByName(read_delta(spark, manifest.deletes_path))
    return shown_docs(docs)


def read_alias(spark, d):
    """The index lines under the latest alias, field by field."""
    manifest = _published(spark, d, alias=True)
    latest = manifest.import_upserts_path.replace("/runs/run-1/", "/latest/run-1/")
    paths = {"id": "$.id", "doc_id": "$.structData.doc_id", "checksum": "$.structData.checksum", "mime_type": "$.content.mimeType", "raw_bytes": "$.content.rawBytes"}
    return spark.read.text(latest).select(*[F.get_json_object("value", path).alias(name) for name, path in paths.items()])


def read_pointer(spark, d):
    """What the success pointer names, with an alias and without."""
    found = []
    for alias in (True, False):
        manifest = _published(spark, d, alias)
        base = manifest.manifest_path.rsplit("/runs/", 1)[0]
        pointed = spark.read.json(f"{base}/state/latest_success.json")
        place = F.regexp_extract("manifest_path", "/docs/([a-z]+)/run-1/manifest.json$", 1)
        rows = spark.read.text(pointed.first()["upserts_path"]).count()
        found.append(pointed.select("run_id", place.alias("place"), "upserts_count", F.lit(rows).cast("bigint").alias("lines")))
    return found[0].unionByName(found[1])


def run_manifest(spark, d):
    manifest = _published(spark, d)
    return spark.read.json(manifest.manifest_path).select(
        "run_id", "connector_id", "started_at", "completed_at", "upserts_count", "deletes_count", "watermark"
    )


def export_csv(spark, d):
    """Customers and suppliers under one header, read back as text."""
    rows = union_rows(
        [
            table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"),
            table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), "s_name"),
        ]
    )
    manifest = publish_csv(rows, Output(scratch(spark, "out"), format="csv"), "people", "run-1", None, AT, AT)
    return csv_pull(spark, manifest.csv_path, "*.csv").select("c_custkey", "c_name", "c_acctbal", "s_name")


# Whole runs


def _connector(view):
    source = Source(type="lake", query=f"SELECT * FROM {view}", watermark_field="changed_at")
    return Connector("docs", "sql_pull", source, Output(""), DOC_MAPPING, schedule="0 * * * *")


def _two_runs(spark, d):
    """A first run over yesterday's rows, a second over today's; returns the store."""
    today = document_rows(spark, d)
    old_text = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("old "), "text")).otherwise(F.col("text"))
    kept = today.where("doc_id % 10 <> 3").withColumn("text", old_text)
    ghosts = today.where("doc_id % 20 = 0").withColumn("doc_id", F.col("doc_id") + 1_000_000_000)
    store = Store(spark, scratch(spark, "store"))
    for run_id, rows in (("r1", kept.unionByName(ghosts)), ("r2", today)):
        connector = _connector(_view(rows, "snapshot"))
        connector = Connector(**connector.__dict__ | {"output": Output(store.root)})
        run_connector(store, connector, run_id, AT, clock=lambda: AT)
    return store


def run_state(spark, d):
    return _two_runs(spark, d).state("docs").select("connector_id", "doc_id", "checksum", "last_seen_run_id")


def run_ledger(spark, d):
    return _two_runs(spark, d).runs().select("run_id", "connector_id", "status", "upserts_count", "deletes_count")


def run_target(spark, d):
    return _two_runs(spark, d).target("docs").select("id", "raw_bytes")


def run_checkpoints(spark, d):
    return _two_runs(spark, d).checkpoints().select("connector_id", "watermark")


# Streams


def drain_queue(spark, d):
    """Pushed documents, taken in as a stream; all batches drained to the state in one run."""
    docs = table(spark, d, "documents")
    body = F.to_json(
        F.struct(
            F.concat(F.lit("d"), "doc_id").alias("doc_id"),
            F.col("source").alias("title"),
            F.col("text").alias("content"),
            F.lit("2024-01-01T00:00:00Z").alias("updated_at"),
            F.sha2("text", 256).alias("checksum"),
            F.lit("UPSERT").alias("op"),
        )
    )
    requests = docs.select(
        F.col("doc_id").cast("string").alias("request_id"),
        F.concat(F.lit("k"), "doc_id").alias("key"),
        F.lit("support").alias("connector_id"),
        F.timestamp_seconds(F.lit(1704067200) - F.col("doc_id")).alias("received_at"),
        F.lit("application/json").alias("content_type"),
        body.alias("body"),
    )
    source = scratch(spark, "requests")
    requests.write.parquet(source)
    store = Store(spark, scratch(spark, "store"))
    stream = spark.readStream.schema(REQUEST_SCHEMA).parquet(source)
    intake_stream(store, stream, scratch(spark, "progress")).awaitTermination()
    connector = Connector("support", "rest_push", Source(type="http"), Output(store.root), DOC_MAPPING)
    drain_together(store, connector, AT)
    return store.state("support").select("doc_id", "checksum")


def status_counts_stream(spark, d):
    events = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    out = scratch(spark, "status")
    run_events = runs_of(events).withColumnRenamed("started_at", "ts")
    status_stream(run_events, out, scratch(spark, "progress")).awaitTermination()
    return shown(status_chart(spark, out), "span_start")


QUERIES = {
    "sql_pull_watermark": sql_pull_watermark,
    "sql_pull_mark": sql_pull_mark,
    "high_water_mark": _marks,
    "clean_errors": _cleaned,
    "csv_pull_row": csv_pull_row,
    "csv_pull_no_header": csv_pull_no_header,
    "csv_ranges": csv_ranges,
    "csv_ranges_no_header": csv_ranges_no_header,
    "csv_pull_file": csv_pull_file,
    "file_checkpoint": _file_checkpoint,
    "file_manifest": file_manifest,
    "json_pages": _page_items,
    "missing_fields": _missing_fields,
    "page_gaps": _page_gaps,
    "page_chain": _page_chain,
    "read_delta": read_published,
    "publish_latest": read_alias,
    "success_pointer": read_pointer,
    "run_manifest": run_manifest,
    "export_csv": export_csv,
    "run_state": run_state,
    "run_target": run_target,
    "run_ledger": run_ledger,
    "run_checkpoints": run_checkpoints,
    "drain_queue": drain_queue,
    "status_stream": status_counts_stream,
}

_NOTE = """CASE o_orderkey % 4 WHEN 0 THEN {error} WHEN 1 THEN '' ELSE 'line "one"' || chr(10) || 'and; ' || o_orderpriority END"""
_LINE_CELLS = """o_orderkey::VARCHAR AS {id}, CASE o_orderkey % 5 WHEN 0 THEN 'a"b'
      WHEN 1 THEN 'first' || chr(10) || '"second",' || chr(10) || chr(10) || 'lastx' WHEN 2 THEN 'only' WHEN 3 THEN '' ELSE 'x' END AS {note},
    CASE o_orderkey % 5 WHEN 0 THEN 'c"d' WHEN 1 THEN o_orderpriority WHEN 3 THEN '' WHEN 4 THEN o_orderpriority END AS {priority} FROM orders"""
_AUTO = f"WITH {SQL_DOCS}, {sql_delta('auto_delete_missing')}"

ORACLES = {
    "sql_pull_watermark": """SELECT o_orderkey, o_orderstatus FROM orders
        WHERE o_orderdate > TIMESTAMP '1998-01-01 00:00:00'""",
    "sql_pull_mark": """SELECT strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%S+00:00') AS watermark FROM orders
        WHERE o_orderdate > TIMESTAMP '1998-01-01 00:00:00'""",
    "high_water_mark": """SELECT 'o_orderdate' AS field, strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%S+00:00') AS watermark
          FROM orders
        UNION ALL SELECT 'o_orderkey', max(o_orderkey::VARCHAR) FROM orders
        UNION ALL SELECT 'o_orderpriority', max(o_orderpriority) FROM orders
        UNION ALL SELECT 'absent', 'before' UNION ALL SELECT 'o_orderstatus', 'before'""",
    "clean_errors": """SELECT event_id, CASE event_type WHEN 'error' THEN '' WHEN 'view' THEN '#ERRORS kept' ELSE props END
        AS cell, event_type FROM events""",
    "csv_pull_row": f"""SELECT o_orderkey::VARCHAR AS o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END
        AS o_orderstatus, {_NOTE.format(error="''")} AS order_note_text,
        CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS folder FROM orders""",
    "csv_pull_no_header": f"""WITH noted AS (SELECT *, {_NOTE.format(error="'#ERROR in cell'")} AS note FROM orders)
        SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey::VARCHAR ELSE note END AS column_1,
               CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE o_orderkey::VARCHAR END AS column_2,
               CASE WHEN o_orderkey % 2 = 0 THEN note END AS column_3,
               CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS folder FROM noted""",
    "csv_ranges": f"SELECT {_LINE_CELLS.format(id='id', note='note', priority='priority')}",
    "csv_ranges_no_header": f"SELECT {_LINE_CELLS.format(id='column_1', note='column_2', priority='column_3')}",
    "csv_pull_file": f"""SELECT o_orderkey::VARCHAR AS o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS o_orderstatus,
        {_NOTE.format(error="'#ERROR in cell'")} AS note FROM orders""",
    "file_checkpoint": """SELECT 1::INTEGER AS v, max(o_orderkey::VARCHAR) AS rw, 6::INTEGER AS fc, true AS hashed, true AS latest
        FROM orders""",
    "file_manifest": f"""WITH lines AS (SELECT '{{"mtime":"' || strftime(make_timestamp((1704067200 + doc_id) * 1000000), '%Y-%m-%dT%H:%M:%S+00:00')
        || '","path":"/in/' || source || '/' || doc_id || '.csv","size":' || n_chars || '}}' AS line FROM documents)
        {sql_tree_digest('lines', prefix='sha256:')}""",
    "json_pages": f"""SELECT 'page ' || (o_orderkey // {_PAGE_ROWS}) AS page, o_orderkey, o_orderstatus, NULL::VARCHAR AS absent
        FROM orders WHERE (o_orderkey // {_PAGE_ROWS}) % 5 <> 2""",
    "missing_fields": """SELECT 'id' AS field, count(*) AS missing FROM orders WHERE o_orderkey % 11 = 0
        UNION ALL SELECT 'title', count(*) FROM orders WHERE o_orderkey % 7 = 0
        UNION ALL SELECT 'note', count(*) FROM orders WHERE o_orderkey % 5 = 0""",
    "page_gaps": f"""WITH pages AS (SELECT DISTINCT o_orderkey // {_PAGE_ROWS} AS n FROM orders),
        stored AS (SELECT n FROM pages WHERE n % 7 <> 4)
        SELECT 'p' || n AS cursor, 'p' || (n + 1) AS next_cursor FROM stored
        WHERE n % 5 NOT IN (1, 2) AND n + 1 NOT IN (SELECT n FROM stored)""",
    "page_chain": f"""WITH pages AS (SELECT DISTINCT o_orderkey // {_PAGE_ROWS} AS n FROM orders)
        SELECT 'p' || n AS cursor, CASE WHEN n % 7 <> 4 THEN row_number() OVER (PARTITION BY n % 7 <> 4 ORDER BY n) - 1 END AS place
        FROM pages""",
    "read_delta": f"{_AUTO} {sql_shown('delta')}",
    "publish_latest": f"""{_AUTO} SELECT 'docs_' || split_part(doc_id, ':', 2) || '_' || left(sha1(doc_id), 8) AS id, doc_id, checksum, mime_type,
        base64(encode(content)) AS raw_bytes FROM delta WHERE op = 'UPSERT'""",
    "success_pointer": f"""{_AUTO}, n AS (SELECT count(*) AS n FROM delta WHERE op = 'UPSERT')
        SELECT 'run-1' AS run_id, place, n AS upserts_count, n AS lines FROM n, (VALUES ('latest'), ('runs')) AS t(place)""",
    "run_manifest": f"""{_AUTO} SELECT 'run-1' AS run_id, 'docs' AS connector_id, '2024-02-01T00:00:00Z' AS started_at,
        '2024-02-01T00:00:00Z' AS completed_at, count(*) FILTER (op = 'UPSERT') AS upserts_count,
        count(*) FILTER (op = 'DELETE') AS deletes_count, 'm1' AS watermark FROM delta""",
    "export_csv": """SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_acctbal::VARCHAR AS c_acctbal, '' AS s_name FROM customer
        UNION ALL SELECT s_suppkey::VARCHAR, '', '', s_name FROM supplier""",
    "run_state": f"""WITH {SQL_DOCS} SELECT 'docs' AS connector_id, doc_id, checksum,
        CASE WHEN n % 10 <> 3 AND n % 7 <> 0 THEN 'r1' ELSE 'r2' END AS last_seen_run_id FROM docs""",
    "run_target": f"""WITH {SQL_DOCS} SELECT 'docs_' || n || '_' || left(sha1(doc_id), 8) AS id,
        base64(encode(content)) AS raw_bytes FROM docs""",
    "run_ledger": f"""{_AUTO} SELECT 'r1' AS run_id, 'docs' AS connector_id, 'SUCCESS' AS status,
          (SELECT count(*) FROM state) AS upserts_count, 0::BIGINT AS deletes_count
        UNION ALL SELECT 'r2', 'docs', 'SUCCESS', count(*) FILTER (op = 'UPSERT'), count(*) FILTER (op = 'DELETE') FROM delta""",
    "run_checkpoints": f"""WITH {SQL_DOCS} SELECT 'docs' AS connector_id,
        strftime(max(changed_at), '%Y-%m-%dT%H:%M:%S+00:00') AS watermark FROM rows_in""",
    "drain_queue": """SELECT 'd' || doc_id AS doc_id, sha256(text) AS checksum FROM documents""",
    "status_stream": f"""WITH {SQL_RUNS} SELECT strftime(date_trunc('hour', started_at), '%Y-%m-%d %H:%M:%S.%f')
        AS span_start, status, count(*) AS runs FROM runs GROUP BY 1, 2""",
}
assert set(ORACLES) <= set(QUERIES)
