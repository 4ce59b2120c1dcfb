"""Pages by ranges, mergeable sketches and kept digest trees."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from snapdelta.operators.dashboard import duration_stats, run_sketches, sketched_durations, sketched_freshness
from snapdelta.operators.merkle import differing_leaves, differing_nodes, differing_rows, stored
from snapdelta.operators.quantile import merged_sketches, rank_error, sketched_percentile, sketches
from snapdelta.operators.ranges import Order, numbered, page
from snapdelta.operators.replay import delta_diff, delta_tree, delta_tree_after, replay_digest, tree_diff

AT = datetime(2026, 1, 1, tzinfo=timezone.utc)


# Pages and numbers


def table(spark, n=5_000, seed=1, parts=5):
    rng = random.Random(seed)
    rows = [(None if rng.random() < 0.01 else rng.choice([7, 7, rng.randrange(400)]), f"r{i}") for i in range(n)]
    return rows, spark.createDataFrame(rows, "at int, id string").repartition(parts)


@pytest.mark.parametrize("falls", [False, True])
def test_pages_of_every_depth(spark, falls):
    rows, df = table(spark, 2_000)
    orders = [Order("at", falls), Order("id")]
    rows.sort(key=lambda r: r[1])
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0), reverse=falls)
    for offset, limit in ((0, 10), (1_000, 40), (1_990, 40), (2_000, 5), (700, 500)):
        found = [tuple(r) for r in page(df, orders, offset, limit, range_rows=200).collect()]
        assert found == rows[offset : offset + limit]


def test_a_deep_page_sorts_few_ranges(spark, tmp_path):
    spark.range(40_000).selectExpr("id * 7 % 40000 AS at", "cast(id AS string) AS id").repartition(8).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    found = page(df, [Order("at", True), Order("id", True)], 20_000, 50, range_rows=1_000)
    assert [r["at"] for r in found.collect()] == list(range(19_999, 19_949, -1))
    sorted_rows = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in sorted_rows
    # What is sorted are the rows of the two ranges that a page can lie in.
    plan = found._jdf.queryExecution().logical()
    child = plan
    while "Sort" not in child.nodeName():
        child = child.children().apply(0)
    kept = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, child.children().apply(0)).count()
    assert kept < 3_000


def test_numbers_follow_the_order(spark):
    rows, df = table(spark, 2_000)
    found = {r["id"]: r["number"] for r in numbered(df, [F.asc_nulls_first("at"), F.col("id")]).collect()}
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert found == {row[1]: i for i, row in enumerate(rows)}
    assert numbered(df.where("false"), [F.col("at")]).count() == 0


# Sketches


def test_sketches_merge_within_their_bound(spark):
    rng = random.Random(4)
    values = {c: sorted(int(rng.paretovariate(1.1) * 100) for _ in range(n)) for c, n in (("a", 40_000), ("b", 9), ("c", 1))}
    rows = [(c, i % 24, v) for c, own in values.items() for i, v in enumerate(own)]
    df = spark.createDataFrame(rows, "c string, hour int, v int").repartition(6)
    hourly = sketches(df, ["c", "hour"], "v")
    merged = sketched_percentile(merged_sketches(hourly, ["c"]), 0.95, "p")
    for row in merged.collect():
        own, error = values[row["c"]], rank_error()
        assert row["rows"] == len(own)
        low, high = sum(v < row["p"] for v in own) / len(own), sum(v <= row["p"] for v in own) / len(own)
        assert low - error <= 0.95 <= high + error
        place = 0.95 * (len(own) - 1)
        exact = own[int(place)] + (own[min(int(place) + 1, len(own) - 1)] - own[int(place)]) * (place - int(place))
        assert row["p_least"] <= exact <= row["p_most"]


def test_run_sketches_serve_any_time(spark):
    rows = [(f"c{i % 3}", "SUCCESS" if i % 4 else "FAILED", AT + timedelta(minutes=i), AT + timedelta(minutes=i, seconds=i % 100)) for i in range(600)]
    runs = spark.createDataFrame(rows, "connector_id string, status string, started_at timestamp, finished_at timestamp")
    found = run_sketches(runs)
    exact = {r["connector_id"]: r for r in duration_stats(runs).collect()}
    for row in sketched_durations(found).collect():
        assert row["p95_seconds_least"] <= exact[row["connector_id"]]["p95_seconds"] <= row["p95_seconds_most"]
    late = {r["connector_id"]: r["p95_lag_seconds"] for r in sketched_freshness(found, AT + timedelta(days=2)).collect()}
    soon = {r["connector_id"]: r["p95_lag_seconds"] for r in sketched_freshness(found, AT + timedelta(days=1)).collect()}
    assert late == {c: lag + 86_400 for c, lag in soon.items()}


# Trees


def delta(spark, n, changed=(), dropped=()):
    sums = F.when(F.col("id").isin(list(changed)), F.lit("other")).otherwise(F.concat(F.lit("s"), "id")) if changed else F.concat(F.lit("s"), "id")
    rows = spark.range(n).where(~F.col("id").isin(list(dropped))) if dropped else spark.range(n)
    return rows.select(
        F.concat(F.lit("d"), "id").alias("doc_id"),
        F.when(F.col("id") % 9 == 0, "DELETE").otherwise("UPSERT").alias("op"),
        sums.alias("checksum"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("id")).alias("updated_at"),
    )


def none_of(df):
    return df.where("false")


def test_few_differing_rows_read_their_leaves(spark, tmp_path):
    a = delta_tree(delta(spark, 100_000), str(tmp_path / "a"), (4, 2))
    changed = delta(spark, 100_000, changed=(5, 70_000), dropped=(44_444,))
    b = delta_tree(changed, str(tmp_path / "b"), (4, 2))
    assert a.root == replay_digest(delta(spark, 100_000), none_of(changed), (4, 2)).first()["digest"]
    assert (a.count, b.count) == (100_000, 99_999)
    nodes = differing_nodes(a, b)
    assert len(nodes) <= 5 and differing_leaves(a, b).count() <= 5
    left, right = differing_rows(a, b)
    # A leaf holds one or two of the rows.
    assert left.count() <= 15 and right.count() <= 15
    assert len(left.inputFiles()) <= 5
    found = {(r["doc_id"], r["checksum"], r["side"]) for r in tree_diff(a, b).collect()}
    assert found == {
        ("d5", "s5", "a"), ("d5", "other", "b"), ("d70000", "s70000", "a"), ("d70000", "other", "b"), ("d44444", "s44444", "a")
    }
    assert differing_nodes(a, a) == [] and tree_diff(a, a).count() == 0


def test_a_tree_moves_on_with_a_delta(spark, tmp_path):
    before, after = delta(spark, 20_000), delta(spark, 20_000, changed=(3, 9), dropped=(8,))
    tree = delta_tree(before, str(tmp_path / "t"), (3, 2))
    gone = before.where("doc_id IN ('d3', 'd8', 'd9')")
    come = after.where("doc_id IN ('d3', 'd9')")
    twice = delta_tree_after(tree, come.unionByName(come), gone, str(tmp_path / "t/next.json"))
    tree_after = delta_tree_after(twice, none_of(come), come, str(tmp_path / "t/last.json"))
    assert tree_after.root == replay_digest(after, none_of(after), (3, 2)).first()["digest"]
    assert twice.count == tree_after.count + 2 and twice.root != tree_after.root
    same = [name for name, node in tree.nodes.items() if tree_after.nodes[name]["data"] == node["data"]]
    assert len(same) >= len(tree.nodes) - 5
    again = stored(spark, str(tmp_path / "t/last.json"))
    assert again.root == tree_after.root and tree_diff(again, tree_after).count() == 0
    assert stored(spark, str(tmp_path / "t/tree.json")).root == tree.root
    found, plain = tree_diff(tree, tree_after), delta_diff(before, after)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))


def test_trees_without_rows(spark, tmp_path):
    none, some = none_of(delta(spark, 10)), delta(spark, 10)
    a, b = delta_tree(none, str(tmp_path / "a"), (3, 2)), delta_tree(some, str(tmp_path / "b"), (3, 2))
    assert a.root == replay_digest(none, none, (3, 2)).first()["digest"] and a.count == 0
    assert tree_diff(a, b).count() == 10 and tree_diff(a, a).count() == 0
