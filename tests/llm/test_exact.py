from __future__ import annotations

import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from snapdelta.llm import exact


def expected(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for doc_id, text in rows:
        own = groups[text or ""]
        keep = max((i for i in own if i is not None), default=None)
        out.append((doc_id, keep, len(own), doc_id == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=repr)


ROWS = [(1, "a"), (2, "a"), (7, "a "), (3, None), (4, ""), (5, "ü" * 70_000), (6, "ü" * 70_000), (None, "a"), (None, "z")]


def test_labels(frame):
    got = exact.labelled(frame(ROWS)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == expected(ROWS)


def test_hot_group_over_many_partitions(frame):
    rows = [(i, "same" if i % 2 else f"text {i}") for i in range(400)]
    got = exact.labelled(frame(rows, 12)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == expected(rows)


def test_survivors_keep_columns(frame):
    rows = [*ROWS, (2, "a"), (9, "b"), (9, "b")]
    docs = frame(rows).withColumn("keep_id", F.lit("x")).withColumn("salt", F.lit(None).cast("int")).withColumn("text_sha256", F.lit(1))
    kept = exact.survivors(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, (r.text or "")[:3]) for r in kept.collect()), key=repr) == [(2, "a"), (4, ""), (6, "üüü"), (7, "a "), (9, "b"), (None, "z")]


def test_empty_table(frame):
    docs = frame([])
    assert exact.labelled(docs).count() == 0
    assert exact.survivors(docs).count() == 0
