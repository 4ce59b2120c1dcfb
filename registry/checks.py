"""Inventories and check results over ``customer``, ``orders``, ``labels`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.bindings import table
from snapdelta.operators.reconcile import pass_rates, reconcile, regressions

PATTERN = r"connectors/[^/]+\.yaml"


def _reconcile(spark, d):
    """Customers that exist against customers that orders name, some names written badly."""
    actual = table(spark, d, "customer").select(
        F.concat(F.lit("connectors/"), F.col("c_custkey"), F.lit(".yaml")).alias("item")
    )
    key, order = F.col("o_custkey"), F.col("o_orderkey")
    declared = table(spark, d, "orders").select(
        F.when(order % 50 == 0, F.concat(F.lit("# note "), order))
        .when(order % 50 == 1, F.lit("  "))
        .when(order % 50 == 2, F.concat(F.lit("connectors/deep/"), key, F.lit(".yaml")))
        .when(order % 50 == 3, F.concat(F.lit("connectors/x"), key, F.lit(".yaml")))
        .when(order % 50 == 4, F.concat(F.lit(" .\\connectors\\"), key, F.lit(".yaml ")))
        .otherwise(F.concat(F.lit("./connectors/"), key, F.lit(".yaml")))
        .alias("item")
    )
    return reconcile(actual, declared, PATTERN)


def _results(spark, d):
    return table(spark, d, "labels").select(
        F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("passed"), (F.col("toxic") == 0).alias("critical")
    )


def _baseline(spark, d):
    docs = table(spark, d, "documents").where("doc_id % 3 <> 0")
    return docs.select(F.col("doc_id").alias("id"), (F.col("n_chars") % 2 == 0).alias("passed"))


QUERIES = {
    "reconcile": _reconcile,
    "regressions": lambda spark, d: regressions(_results(spark, d), _baseline(spark, d)),
    "pass_rates": lambda spark, d: pass_rates(_results(spark, d)),
}

ORACLES = {
    "reconcile": """WITH actual AS (SELECT DISTINCT 'connectors/' || c_custkey || '.yaml' AS item FROM customer),
        entries AS (SELECT CASE o_orderkey % 50 WHEN 0 THEN NULL WHEN 1 THEN NULL
            WHEN 2 THEN 'connectors/deep/' || o_custkey || '.yaml' WHEN 3 THEN 'connectors/x' || o_custkey || '.yaml'
            ELSE 'connectors/' || o_custkey || '.yaml' END AS item FROM orders),
        listed AS (SELECT item, count(*) AS n FROM entries WHERE item IS NOT NULL AND item NOT LIKE 'connectors/%/%' GROUP BY 1)
        SELECT 'missing' AS kind, item FROM actual WHERE item NOT IN (SELECT item FROM listed)
        UNION ALL SELECT 'stale', item FROM listed WHERE item NOT IN (SELECT item FROM actual)
        UNION ALL SELECT 'duplicate', item FROM listed WHERE n > 1
        UNION ALL SELECT DISTINCT 'malformed', item FROM entries WHERE item LIKE 'connectors/%/%'""",
    "regressions": """SELECT l.doc_id AS id FROM labels l
        LEFT JOIN (SELECT doc_id, n_chars % 2 = 0 AS passed FROM documents WHERE doc_id % 3 <> 0) b USING (doc_id)
        WHERE quality <> 1 AND coalesce(b.passed, true)""",
    "pass_rates": """WITH counted AS (SELECT count(*) AS total, count(*) FILTER (quality = 1) AS passed,
            count(*) FILTER (toxic = 0) AS critical_total, count(*) FILTER (toxic = 0 AND quality = 1) AS critical_passed
          FROM labels),
        rated AS (SELECT *, CASE WHEN total > 0 THEN passed / total * 100 ELSE 100.0 END AS pass_rate_percent,
          CASE WHEN critical_total > 0 THEN critical_passed / critical_total * 100 ELSE 100.0 END
            AS critical_pass_rate_percent FROM counted)
        SELECT *, pass_rate_percent >= 95 AND critical_pass_rate_percent >= 100 AS ok FROM rated""",
}
assert set(ORACLES) <= set(QUERIES)
