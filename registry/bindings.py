"""How the test tables stand for connector data, once for Spark and once as SQL.

``documents`` is a snapshot and, with some ids left out, changed or added, the state before it.
``events`` is the run ledger and the push queue. ``conversations`` are push requests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapdelta.functions.digest import WIDTHS
from snapdelta.operators.diff import changed_keys, delta_of
from snapdelta.operators.normalize import Mapping, normalize
from snapdelta.session import settled

NOW = "2024-02-01T00:00:00+00:00"
RUN = "run-1"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Documents: a snapshot of source rows and its canonical form

DOC_MAPPING = Mapping(
    id_field="doc_id",
    title_field="title",
    content_template="{{ text }}",
    uri_template="https://x/{{ doc_id }}",
    acl_users_field="readers",
    acl_groups_field="source",
    metadata_fields=("lang", "source", "absent"),
)


def document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    readers = F.when(F.col("doc_id") % 3 != 0, F.array("lang", F.lit(None), "source"))
    return docs.select(
        "doc_id",
        "text",
        "lang",
        "source",
        F.concat(F.lit("doc "), F.col("doc_id")).alias("title"),
        readers.alias("readers"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id")).alias("changed_at"),
    )


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize(document_rows(spark, sf_dir), DOC_MAPPING, "docs", "changed_at", NOW)


def prior_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State before the snapshot: a tenth of the ids missing, a seventh stale, some ghosts added."""
    rows = document_rows(spark, sf_dir)
    number = F.expr("cast(substring_index(doc_id, ':', -1) as bigint)")
    docs = snapshot(spark, sf_dir).select("doc_id", "checksum", "updated_at", number.alias("n"))
    sums = F.when(F.col("n") % 7 == 0, "sha256:stale").otherwise(F.col("checksum"))
    kept = docs.where("n % 10 <> 3").select("doc_id", sums.alias("checksum"), "updated_at")
    ghosts = rows.where("doc_id % 20 = 0").select(
        F.concat(F.lit("docs:"), F.col("doc_id") + 1_000_000_000).alias("doc_id"),
        F.lit("sha256:ghost").alias("checksum"),
        F.col("changed_at").alias("updated_at"),
    )
    return kept.unionByName(ghosts).select(
        F.lit("docs").alias("connector_id"),
        "doc_id",
        "checksum",
        F.col("updated_at").alias("source_updated_at"),
        F.lit("run-0").alias("last_seen_run_id"),
    )


def run_delta(spark: SparkSession, sf_dir: str, policy: str = "auto_delete_missing", state: DataFrame | None = None) -> DataFrame:
    """The delta as a run finds it: changed keys first, then the documents of those; content is not shuffled for it."""
    known = prior_state(spark, sf_dir) if state is None else state
    changes = settled(changed_keys(snapshot(spark, sf_dir), known, policy), "changes")
    return delta_of(document_rows(spark, sf_dir), changes, DOC_MAPPING, "docs", "changed_at", policy, NOW)


def shown_docs(docs: DataFrame) -> DataFrame:
    """Documents with lists and times as text, for comparing."""
    return docs.select(
        "doc_id",
        "title",
        "content",
        "uri",
        "mime_type",
        F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"),
        F.to_json("acl_users").alias("acl_users"),
        F.to_json("acl_groups").alias("acl_groups"),
        "metadata",
        "checksum",
        "op",
    )


SQL_DOCS = """
rows_in AS (
  SELECT doc_id AS n, text, lang, source, 'doc ' || doc_id AS title,
         CASE WHEN doc_id % 3 <> 0 THEN [lang, source] ELSE [] END AS readers,
         to_timestamp(1704067200 + doc_id)::TIMESTAMP AS changed_at
  FROM documents),
docs AS (
  SELECT n, 'docs:' || n AS doc_id, title, text AS content, 'https://x/' || n AS uri, 'text/plain' AS mime_type,
         changed_at AS updated_at, readers AS acl_users, [source] AS acl_groups, lang, source,
         to_json({'connector_id': 'docs', 'lang': lang, 'source': source})::VARCHAR AS metadata,
         'sha256:' || sha256(to_json({'acl_groups': [source], 'acl_users': readers, 'content': text,
             'doc_id': 'docs:' || n, 'metadata': {'connector_id': 'docs', 'lang': lang, 'source': source},
             'mime_type': 'text/plain', 'title': title, 'uri': 'https://x/' || n})::VARCHAR) AS checksum,
         'UPSERT' AS op
  FROM rows_in),
state AS (
  SELECT 'docs' AS connector_id, doc_id, CASE WHEN n % 7 = 0 THEN 'sha256:stale' ELSE checksum END AS checksum,
         updated_at AS source_updated_at, 'run-0' AS last_seen_run_id
  FROM docs WHERE n % 10 <> 3
  UNION ALL
  SELECT 'docs', 'docs:' || (n + 1000000000), 'sha256:ghost', changed_at, 'run-0' FROM rows_in WHERE n % 20 = 0)
"""

_SQL_UPSERTS = """
  SELECT d.doc_id, d.title, d.content, d.uri, d.mime_type, d.updated_at, d.acl_users, d.acl_groups, d.metadata,
         d.checksum, d.op
  FROM docs d LEFT JOIN state s ON d.doc_id = s.doc_id WHERE s.checksum IS NULL OR s.checksum <> d.checksum
"""


def sql_tree_digest(lines: str, widths: tuple[int, ...] = WIDTHS, prefix: str = "") -> str:
    """CTEs and the final select of ``functions.digest.tree_digest`` over the column ``line`` of a CTE."""
    parts = [
        f"hashes AS (SELECT sha256(line) AS h, count(*) AS n FROM {lines} GROUP BY 1)",
        f"level0 AS (SELECT left(h, {widths[0]}) AS prefix, h || ':' || n AS item, n FROM hashes)",
    ]
    for i, above in enumerate([*widths[1:], 0]):
        folded = f"SELECT prefix, sha256(string_agg(item, ',' ORDER BY item)) AS digest, sum(n) AS n FROM level{i} GROUP BY prefix"
        parts.append(f"level{i + 1} AS (SELECT left(prefix, {above}) AS prefix, prefix || ':' || digest AS item, n FROM ({folded}))")
    return f""", {', '.join(parts)} SELECT '{prefix}' || sha256(coalesce(string_agg(item, ',' ORDER BY item), '')) AS digest,
        coalesce(sum(n), 0)::BIGINT AS rows FROM level{len(widths)}"""


def sql_delta(policy: str, name: str = "delta") -> str:
    """CTE with the delta of ``docs`` against ``state``."""
    if policy == "never_delete":
        return f"{name} AS ({_SQL_UPSERTS})"
    soft = policy == "soft_delete_only"
    time = "s.source_updated_at" if soft else "TIMESTAMP '2024-02-01 00:00:00'"
    facts = '{"connector_id":"docs","soft_delete":true}' if soft else '{"connector_id":"docs"}'
    return f"""{name} AS ({_SQL_UPSERTS}
  UNION ALL
  SELECT s.doc_id, '', '', NULL, 'text/plain', {time}, []::VARCHAR[], []::VARCHAR[], '{facts}',
         'sha256:' || sha256(s.doc_id), 'DELETE'
  FROM state s WHERE NOT EXISTS (SELECT 1 FROM docs d WHERE d.doc_id = s.doc_id))"""


def sql_shown(name: str) -> str:
    return f"""SELECT doc_id, title, content, uri, mime_type, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at,
       to_json(acl_users)::VARCHAR AS acl_users, to_json(acl_groups)::VARCHAR AS acl_groups, metadata, checksum, op
FROM {name}"""


# Events: the run ledger, checkpoints, catalog and push queue

CONNECTOR = "concat('c', cast(user_id % 20 as string))"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs_of(table(spark, sf_dir, "events"))


def runs_of(events: DataFrame) -> DataFrame:
    """The run ledger out of events, in a table or a stream."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).selectExpr(
        "cast(event_id as string) as run_id",
        f"{CONNECTOR} as connector_id",
        "case event_type when 'error' then 'FAILED' when 'view' then 'RUNNING' else 'SUCCESS' end as status",
        "ts as started_at",
        "case when event_type <> 'view' then timestamp_micros(unix_micros(ts) + cast(floor(value) as bigint) * 1000000)"
        " end as finished_at",
        "coalesce(cast(get_json_object(props, '$.k') as bigint), 0) as upserts_count",
        "cast(event_id % 3 as bigint) as deletes_count",
        "case when event_type = 'error' then concat('Error', cast(event_id % 4 as string)) end as error_class",
        "case when event_type = 'error' then concat('failed at ', cast(value as decimal(18, 2))) end as error_message",
    )


def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = runs(spark, sf_dir).where("status = 'SUCCESS' and connector_id <> 'c7'")
    return done.groupBy("connector_id").agg(
        F.max("run_id").alias("watermark"), F.max("finished_at").alias("updated_at")
    )


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.where("event_type = 'purchase'").selectExpr(
        "cast(event_id as string) as run_id",
        f"{CONNECTOR} as connector_id",
        "concat('k', cast(event_id as string)) as idempotency_key",
        "case when event_id % 3 = 0 then 'PENDING' else 'PROCESSED' end as status",
        "ts as created_at",
    )


def spec_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spec rows, one per customer: some without a name, many under one name."""
    customer = table(spark, sf_dir, "customer")
    name = F.when(F.col("c_custkey") % 9 != 8, F.concat(F.lit("c"), (F.col("c_custkey") % 22).cast("string")))
    mode = F.when(F.col("c_custkey") % 2 == 0, "sql_pull").otherwise("rest_push")
    body = F.to_json(
        F.struct(
            F.struct(name.alias("name")).alias("metadata"),
            F.struct(
                mode.alias("mode"),
                F.concat(F.lit("0 "), "c_custkey", F.lit(" * * *")).alias("schedule"),
                F.struct(F.lower("c_mktsegment").alias("type")).alias("source"),
            ).alias("spec"),
        )
    )
    path = F.concat(F.lit("connectors/"), F.lpad(F.col("c_custkey").cast("string"), 12, "0"), F.lit(".yaml"))
    return customer.select(path.alias("path"), body.alias("body"))


SQL_RUNS = """
runs AS (
  SELECT event_id::VARCHAR AS run_id, 'c' || (user_id % 20) AS connector_id,
         CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'view' THEN 'RUNNING' ELSE 'SUCCESS' END AS status,
         ts AS started_at,
         CASE WHEN event_type <> 'view' THEN ts + to_seconds(floor(value)::BIGINT) END AS finished_at,
         coalesce((props::JSON ->> '$.k')::BIGINT, 0) AS upserts_count, event_id % 3 AS deletes_count,
         CASE WHEN event_type = 'error' THEN 'Error' || (event_id % 4) END AS error_class,
         CASE WHEN event_type = 'error' THEN 'failed at ' || value::DECIMAL(18, 2) END AS error_message
  FROM events)
"""
SQL_CHECKPOINTS = """
checkpoints AS (
  SELECT connector_id, max(run_id) AS watermark, max(finished_at) AS updated_at
  FROM runs WHERE status = 'SUCCESS' AND connector_id <> 'c7' GROUP BY connector_id)
"""
SQL_BATCHES = """
batches AS (
  SELECT event_id::VARCHAR AS run_id, 'c' || (user_id % 20) AS connector_id, 'k' || event_id AS idempotency_key,
         CASE WHEN event_id % 3 = 0 THEN 'PENDING' ELSE 'PROCESSED' END AS status, ts AS created_at
  FROM events WHERE event_type = 'purchase')
"""
SQL_CATALOG = """
specs AS (
  SELECT 'connectors/' || lpad(c_custkey::VARCHAR, 12, '0') || '.yaml' AS path,
         CASE WHEN c_custkey % 9 <> 8 THEN 'c' || (c_custkey % 22) END AS connector_id,
         CASE WHEN c_custkey % 2 = 0 THEN 'sql_pull' ELSE 'rest_push' END AS mode,
         '0 ' || c_custkey || ' * * *' AS schedule, lower(c_mktsegment) AS source_type
  FROM customer),
catalog AS (
  SELECT connector_id, min(path) AS path, arg_max(mode, path) AS mode, arg_max(schedule, path) AS schedule,
         arg_max(source_type, path) AS source_type
  FROM specs WHERE connector_id IS NOT NULL GROUP BY connector_id)
"""
