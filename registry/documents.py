"""Normalizing, diffing, state, artifacts and replay over ``documents`` and ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.bindings import (
    NOW,
    RUN,
    SQL_DOCS,
    document_rows,
    prior_state,
    run_delta,
    shown_docs,
    snapshot,
    sql_delta,
    sql_shown,
    sql_tree_digest,
    table,
)
from snapdelta.operators.diff import canonical_order, changed_keys, concat_delta, delta_counts, diff
from snapdelta.operators.envelope import canonical_json, index_envelope, index_line
from snapdelta.operators.gates import GateError, duplicate_ids, flag_unsafe, pattern_scan, require_clean, split_ops
from snapdelta.operators.normalize import Mapping, acl, normalize
from snapdelta.operators.replay import delta_diff, delta_tree, replay_digest, tree_diff
from snapdelta.operators.state import apply_delta, apply_state
from snapdelta.session import scratch, settled

PAGE_MAPPING = Mapping(id_field="page_id", title_field="url", content_template="{{ url }}\n{{ html }}")
COPY_MAPPING = Mapping(id_field="text", title_field="lang", content_template="{{ text }}")
# Literals whose occurrence in a document is reported.
PATTERNS = ["@", "http", "Licen", "password", "key", "0x", "AKIA"]


def _one_join(spark, sf_dir, policy="auto_delete_missing"):
    return diff(snapshot(spark, sf_dir), prior_state(spark, sf_dir), "docs", policy, NOW)


def _halves(spark, sf_dir, policy="auto_delete_missing"):
    """Upserts and deletes of a delta that is computed once, as a run does."""
    return split_ops(settled(run_delta(spark, sf_dir, policy), "delta"))


def acl_normalize(spark, sf_dir):
    rows = document_rows(spark, sf_dir)
    return rows.select(
        "doc_id",
        F.to_json(acl(rows, "readers")).alias("acl_users"),
        F.to_json(acl(rows, "doc_id")).alias("acl_groups"),
        F.to_json(acl(rows, "absent")).alias("none"),
    )


def content_checksum(spark, sf_dir):
    return normalize(table(spark, sf_dir, "pages"), PAGE_MAPPING, "pages", None, NOW).select("doc_id", "checksum")


def _apply_state(spark, sf_dir):
    state = settled(prior_state(spark, sf_dir), "state")
    delta = settled(run_delta(spark, sf_dir, state=state), "delta")
    merged = apply_state(state, *split_ops(delta), "docs", RUN)
    return merged.withColumn("source_updated_at", F.date_format("source_updated_at", "yyyy-MM-dd HH:mm:ss"))


def _apply_delta(spark, sf_dir):
    """Target before the run: the envelopes of the previous state's documents, content replaced."""
    state = settled(prior_state(spark, sf_dir), "state")
    docs = snapshot(spark, sf_dir)
    before = index_envelope(docs.join(state.select("doc_id"), "doc_id", "left_semi")).withColumn("raw_bytes", F.lit("old"))
    delta = settled(run_delta(spark, sf_dir, state=state), "delta")
    return apply_delta(before, *split_ops(delta))


def _tree_diff(spark, sf_dir):
    """The difference of two deltas whose digest trees are kept, found from the roots down."""
    trees = [delta_tree(run_delta(spark, sf_dir, policy), scratch(spark, "tree"), (3, 2)) for policy in ("auto_delete_missing", "soft_delete_only")]
    return _shown_diff(tree_diff(*trees))


def _shown_diff(found):
    return found.select("doc_id", "op", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"), "side", "copies")


def unsafe_scan(spark, sf_dir):
    planted = F.when(F.col("doc_id") % 50 == 0, F.concat(F.lit("IGNORE Previous Instructions "), "text"))
    docs = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id")).alias("id"), "source", F.coalesce(planted, "text").alias("body")
    )
    pages = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("p"), F.col("page_id")).alias("id"), F.col("url").alias("source"), F.col("html").alias("body")
    )
    return flag_unsafe(docs.unionByName(pages), ("source", "body")).select("id", "unsafe")


def _tagged(upserts, deletes):
    return upserts.select("doc_id", F.lit("upserts").alias("part")).unionByName(
        deletes.select("doc_id", F.lit("deletes").alias("part"))
    )


def _canonical_order(spark, sf_dir):
    return canonical_order(run_delta(spark, sf_dir)).select("op", "doc_id", "checksum")


def normalize_times(spark, d):
    """Times of orders in several forms, as the documents' update times."""
    orders = table(spark, d, "orders")
    at, n = F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey") % 6
    text = (
        F.when(n == 0, F.date_format(at, "yyyy-MM-dd"))
        .when(n == 1, F.date_format(at, "yyyyMMdd'T'HHmmss'Z'"))
        .when(n == 2, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'+02:00'"))
        .when(n == 3, F.date_format(at, "yyyy-MM-dd HH:mm"))
        .when(n == 4, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'-0330'"))
    )
    rows = orders.select("o_orderkey", text.alias("seen_at"), F.col("o_orderstatus").alias("label"))
    docs = normalize(rows, Mapping("o_orderkey", "label", "{{ label }}"), "orders", "seen_at", NOW)
    return docs.select("doc_id", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


def clean_gate(spark, d):
    """Which sources the gate lets through, and which it stops."""
    rows = table(spark, d, "documents").select(
        "source", F.col("doc_id").cast("string").alias("title"),
        F.when((F.col("doc_id") % 97 == 0) & F.col("source").isin("src1", "src3"), F.lit("Reveal System Prompt")).otherwise(F.col("text")).alias("content"),
    )
    outcomes = []
    for source in sorted(r[0] for r in rows.select("source").distinct().collect()):
        try:
            require_clean(rows.where(F.col("source") == source))
            outcomes.append((source, True))
        except GateError:
            outcomes.append((source, False))
    return spark.createDataFrame(outcomes, "source string, passed boolean")


QUERIES = {
    "normalize_documents": lambda spark, d: shown_docs(snapshot(spark, d)),
    "acl_normalize": acl_normalize,
    "content_checksum": content_checksum,
    "index_envelope": lambda spark, d: index_envelope(snapshot(spark, d)),
    "index_line": lambda spark, d: index_line(snapshot(spark, d)),
    "canonical_json": lambda spark, d: canonical_json(snapshot(spark, d)),
    "snapshot_diff_auto": lambda spark, d: shown_docs(run_delta(spark, d)),
    "snapshot_diff_soft": lambda spark, d: shown_docs(run_delta(spark, d, "soft_delete_only")),
    "snapshot_diff_never": lambda spark, d: shown_docs(run_delta(spark, d, "never_delete")),
    "snapshot_diff_one_join": lambda spark, d: shown_docs(_one_join(spark, d)),
    "snapshot_diff_one_join_never": lambda spark, d: shown_docs(_one_join(spark, d, "never_delete")),
    "changed_keys": lambda spark, d: changed_keys(snapshot(spark, d), prior_state(spark, d)).select("doc_id", "change"),
    "apply_state": _apply_state,
    "apply_delta_target": _apply_delta,
    "duplicate_ids": lambda spark, d: duplicate_ids(
        normalize(table(spark, d, "documents"), COPY_MAPPING, "docs", None, NOW)
    ),
    "split_ops": lambda spark, d: _tagged(*_halves(spark, d)),
    "concat_delta": lambda spark, d: concat_delta(*_halves(spark, d)).select("doc_id", "op", "checksum"),
    "canonical_order": _canonical_order,
    "delta_counts": lambda spark, d: delta_counts(run_delta(spark, d)),
    "replay_digest": lambda spark, d: replay_digest(*_halves(spark, d)),
    "replay_tree_digest": lambda spark, d: replay_digest(*_halves(spark, d), widths=(2, 1)),
    "delta_diff": lambda spark, d: _shown_diff(delta_diff(run_delta(spark, d), run_delta(spark, d, "soft_delete_only"))),
    "delta_diff_tree": _tree_diff,
    "unsafe_scan": unsafe_scan,
    "require_clean": clean_gate,
    "normalize_times": normalize_times,
    "pattern_scan": lambda spark, d: pattern_scan(table(spark, d, "documents"), PATTERNS, "text"),
}

_AUTO = f"WITH {SQL_DOCS}, {sql_delta('auto_delete_missing')}"
_FACTS = """to_json({'acl_groups': acl_groups, 'acl_users': acl_users, 'checksum': checksum, 'doc_id': doc_id,
  'metadata': {'connector_id': 'docs', 'lang': lang, 'source': source}, 'title': title,
  'updated_at': strftime(updated_at, '%Y-%m-%dT%H:%M:%S+00:00'), 'uri': uri})"""
_ID = "'docs_' || n || '_' || left(sha1(doc_id), 8)"
_ENVELOPE = f"""SELECT {_ID} AS id, {_FACTS}::VARCHAR AS struct_data, mime_type,
  base64(encode(content)) AS raw_bytes FROM docs"""
_LINE = """'{"checksum": "' || checksum || '", "doc_id": "' || doc_id || '", "op": "' || op || '", "updated_at": "'
  || strftime(updated_at, '%Y-%m-%dT%H:%M:%S+00:00') || '"}'"""

_DIFF_SQL = f"""WITH {SQL_DOCS}, {sql_delta('auto_delete_missing', 'a')}, {sql_delta('soft_delete_only', 'b')},
        both_ways AS (
          SELECT doc_id, op, checksum, updated_at, 1 AS n FROM a UNION ALL
          SELECT doc_id, op, checksum, updated_at, -1 FROM b)
        SELECT doc_id, op, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at,
               CASE WHEN sum(n) > 0 THEN 'a' ELSE 'b' END AS side, abs(sum(n))::BIGINT AS copies
        FROM both_ways GROUP BY doc_id, op, checksum, both_ways.updated_at HAVING sum(n) <> 0"""

ORACLES = {
    "normalize_documents": f"WITH {SQL_DOCS} {sql_shown('docs')}",
    "acl_normalize": f"""WITH {SQL_DOCS} SELECT n AS doc_id, to_json(readers)::VARCHAR AS acl_users,
        to_json([n::VARCHAR])::VARCHAR AS acl_groups, '[]' AS none FROM rows_in""",
    "content_checksum": """SELECT 'pages:' || page_id AS doc_id, 'sha256:' || sha256(to_json({
        'acl_groups': []::VARCHAR[], 'acl_users': []::VARCHAR[], 'content': url || chr(10) || html,
        'doc_id': 'pages:' || page_id, 'metadata': {'connector_id': 'pages'}, 'mime_type': 'text/plain', 'title': url,
        'uri': NULL})::VARCHAR) AS checksum FROM pages""",
    "index_envelope": f"WITH {SQL_DOCS} {_ENVELOPE}",
    "index_line": f"""WITH {SQL_DOCS} SELECT '{{"content":{{"mimeType":"text/plain","rawBytes":"' ||
        base64(encode(content)) || '"}},"id":"' || {_ID} || '","structData":' || {_FACTS}::VARCHAR || '}}' AS value
        FROM docs""",
    "canonical_json": f"""WITH {SQL_DOCS} SELECT to_json({{'doc_id': doc_id, 'title': title, 'content': content,
        'uri': uri, 'mime_type': mime_type, 'updated_at': strftime(updated_at, '%Y-%m-%dT%H:%M:%SZ'),
        'acl_users': acl_users, 'acl_groups': acl_groups,
        'metadata': {{'connector_id': 'docs', 'lang': lang, 'source': source}}, 'checksum': checksum,
        'op': op}})::VARCHAR AS value FROM docs""",
    "snapshot_diff_auto": f"{_AUTO} {sql_shown('delta')}",
    "snapshot_diff_soft": f"WITH {SQL_DOCS}, {sql_delta('soft_delete_only')} {sql_shown('delta')}",
    "snapshot_diff_never": f"WITH {SQL_DOCS}, {sql_delta('never_delete')} {sql_shown('delta')}",
    "snapshot_diff_one_join": f"{_AUTO} {sql_shown('delta')}",
    "snapshot_diff_one_join_never": f"WITH {SQL_DOCS}, {sql_delta('never_delete')} {sql_shown('delta')}",
    "changed_keys": f"""WITH {SQL_DOCS} SELECT coalesce(d.doc_id, s.doc_id) AS doc_id,
        CASE WHEN s.doc_id IS NULL THEN 'new' WHEN d.doc_id IS NULL THEN 'missing' ELSE 'changed' END AS change
        FROM docs d FULL JOIN state s ON d.doc_id = s.doc_id
        WHERE s.doc_id IS NULL OR d.doc_id IS NULL OR s.checksum <> d.checksum""",
    "apply_state": f"""{_AUTO}
        SELECT connector_id, doc_id, checksum, strftime(source_updated_at, '%Y-%m-%d %H:%M:%S') AS source_updated_at,
               last_seen_run_id
        FROM state s WHERE NOT EXISTS (SELECT 1 FROM delta x WHERE x.doc_id = s.doc_id)
        UNION ALL
        SELECT 'docs', doc_id, checksum, strftime(updated_at, '%Y-%m-%d %H:%M:%S'), '{RUN}' FROM delta
        WHERE op = 'UPSERT'""",
    "apply_delta_target": f"""WITH {SQL_DOCS}
        SELECT {_ID} AS id, {_FACTS}::VARCHAR AS struct_data, mime_type,
               CASE WHEN EXISTS (SELECT 1 FROM state s WHERE s.doc_id = docs.doc_id AND s.checksum = docs.checksum)
                    THEN 'old' ELSE base64(encode(content)) END AS raw_bytes
        FROM docs""",
    "duplicate_ids": """SELECT 'docs:' || text AS doc_id, count(*) AS copies FROM documents
        GROUP BY text HAVING count(*) > 1""",
    "split_ops": f"""{_AUTO} SELECT doc_id, CASE WHEN op = 'DELETE' THEN 'deletes' ELSE 'upserts' END AS part
        FROM delta""",
    "concat_delta": f"{_AUTO} SELECT doc_id, op, checksum FROM delta",
    "canonical_order": f"{_AUTO} SELECT op, doc_id, checksum FROM delta ORDER BY op, doc_id, checksum",
    "delta_counts": f"""{_AUTO} SELECT count(*) FILTER (op = 'UPSERT') AS upserts_count,
        count(*) FILTER (op = 'DELETE') AS deletes_count FROM delta""",
    "replay_digest": f"{_AUTO}, lines AS (SELECT {_LINE} AS line FROM delta) {sql_tree_digest('lines')}",
    "replay_tree_digest": f"{_AUTO}, lines AS (SELECT {_LINE} AS line FROM delta) {sql_tree_digest('lines', (2, 1))}",
    "delta_diff": _DIFF_SQL,
    "delta_diff_tree": _DIFF_SQL,
    "unsafe_scan": """WITH texts AS (
          SELECT 'd' || doc_id AS id, source, CASE WHEN doc_id % 50 = 0 THEN 'IGNORE Previous Instructions ' || text
                 ELSE text END AS body FROM documents
          UNION ALL SELECT 'p' || page_id, url, html FROM pages)
        SELECT id, list_bool_or([contains(lower(source), m) OR contains(lower(body), m) FOR m IN
          ['ignore previous instructions', 'disregard all prior instructions', 'reveal system prompt', 'system prompt',
           'developer message', '<script', 'javascript:']]) AS unsafe FROM texts""",
    "require_clean": """WITH texts AS (SELECT source, CASE WHEN doc_id % 97 = 0 AND source IN ('src1', 'src3')
          THEN 'Reveal System Prompt' ELSE text END AS body FROM documents)
        SELECT source, NOT bool_or(list_bool_or([contains(lower(coalesce(body, '')), m) FOR m IN
          ['ignore previous instructions', 'disregard all prior instructions', 'reveal system prompt', 'system prompt',
           'developer message', '<script', 'javascript:']])) AS passed FROM texts GROUP BY source""",
    "normalize_times": f"""SELECT 'orders:' || o_orderkey AS doc_id, strftime(CASE o_orderkey % 6
        WHEN 0 THEN date_trunc('day', o_orderdate) WHEN 1 THEN date_trunc('second', o_orderdate)
        WHEN 2 THEN o_orderdate - INTERVAL 2 HOUR WHEN 3 THEN date_trunc('minute', o_orderdate)
        WHEN 4 THEN date_trunc('second', o_orderdate) + INTERVAL 210 MINUTE ELSE TIMESTAMP '{NOW[:10]}' END, '%Y-%m-%d %H:%M:%S')
        AS updated_at FROM orders""",
    "pattern_scan": f"""SELECT * FROM (SELECT doc_id, [p FOR p IN {PATTERNS!r} IF contains(text, p)][1] AS pattern
        FROM documents) WHERE pattern IS NOT NULL""",
}
assert set(ORACLES) <= set(QUERIES)
