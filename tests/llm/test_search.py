from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from snapdelta.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, queries, k=10):
    """Every query against every document."""
    counted = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    holding = Counter(term for _, c in counted for term in c)
    rows = []
    for item, text in dict.fromkeys((i, t or "") for i, t in queries):
        found = []
        for doc_id, c in counted:
            m = 25 + 75 * sum(c.values()) * n_docs // n_terms
            score = 0
            for term in terms(text):
                if c[term]:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding[term] + 1)))
                    score += weight * (10**9 * c[term] // (1000 * c[term] + 8 * m))
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0, doc_id))
        rows += [(item, rank, row[3], -row[0]) for rank, row in enumerate(sorted(found, key=lambda r: r[:3])[:k], 1)]
    return sorted(rows, key=repr)


def planted(seed, n=400):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.7)) % 500}" for _ in range(3_000)] + ["Été", "naïve", "漢字", "x_y", "a-b", "Q7"]
    fresh = lambda size: [rng.choice(vocabulary) for _ in range(size)]
    docs = [(i, " ".join(fresh(rng.randint(0, 120)))) for i in range(n)]
    passage = " ".join(fresh(40))
    docs += [(n + i, passage if i % 3 else f"{passage}, {passage}!") for i in range(30)]
    docs += [(n + 30, None), (n + 31, ""), (n + 32, " .,;:! "), (n + 33, "ÉTÉ w1")]
    queries = [(i, " ".join(fresh(rng.randint(1, 40)))) for i in range(25)]
    return docs, queries + [(25, passage), (26, "W1 w1 w1"), (27, None), (28, "absent"), (29, "!!")]


@pytest.fixture(scope="module")
def asked(spark):
    return lambda rows: spark.createDataFrame(rows, "item_id int, text string")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, frame, asked, monkeypatch, seed):
    docs, queries = planted(seed)
    found = search.ranked(frame(docs), asked(queries))
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=repr) == brute(docs, queries)


def test_blocks_of_queries(spark, frame, asked):
    docs, queries = planted(4, 100)
    found = search.ranked(frame(docs), asked(queries), at_once=7)
    assert sorted(map(tuple, found.collect()), key=repr) == brute(docs, queries)


def test_blocks_are_skipped_only_by_their_bounds():
    rng = np.random.default_rng(3)
    n, width = 900, 60
    topics = rng.integers(0, 12, n)
    rows = [np.unique(np.concatenate((rng.integers(0, 6, 2), 6 + topics[i] * 4 + rng.integers(0, 4, 3)))) for i in range(n)]
    at = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    flat = np.concatenate(rows)
    adds = rng.integers(1, 10**6, len(flat))
    weights = rng.integers(1, 5_000, width)
    shard = search.Shard(list(range(n)), at, flat, adds, weights)
    dense = np.zeros((n, width), np.int64)
    dense[np.repeat(np.arange(n), np.diff(at)), flat] = adds
    for term in range(54):
        docs, starts, summaries = shard.blocks(term)
        assert (np.diff(starts) <= search.BLOCK).all()
        for k in range(len(starts) - 1):
            members = docs[starts[k] : starts[k + 1]]
            assert len(set(shard.cells[members])) == 1
            assert (summaries[k] == shard.vectors[members].max(0)).all()
    shard.scored = 0
    for topic in range(12):
        own = np.array([0, 1, *range(6 + topic * 4, 10 + topic * 4)])
        best = search.Best(10)
        shard.search(own, weights[own], best)
        scores = dense[:, own] @ weights[own]
        assert best.rows == sorted(((int(s), d) for d, s in enumerate(scores)), key=lambda r: (-r[0], r[1]))[:10]
    # Two terms are everywhere; summaries keep most of their documents unscored.
    assert shard.scored < 12 * n / 2


def test_ties_go_to_the_smaller_id_and_nulls_last(spark, frame, asked):
    docs = [(i, "same words") for i in (9, 4, 7, None, None, 4)] + [(100 + i, f"other{i}") for i in range(20)]
    found = search.ranked(frame(docs), asked([(1, "same"), (1, "same")]), k=5)
    assert [r[2] for r in sorted(found.collect(), key=lambda r: r[1])] == [4, 4, 7, 9, None]


def test_long_texts_empty_tables_and_other_columns(spark, frame, asked):
    docs = [(1, "needle " + "hay " * 300_000), (2, "hay"), (3, "needle")]
    queries = asked([(1, "needle hay"), (2, "hay " * 50_000)])
    wide = frame(docs).selectExpr("*", "1 AS n", "'x' AS ids", "2 AS score", "3 AS query")
    found = search.ranked(wide, queries)
    assert sorted(map(tuple, found.collect())) == brute(docs, [(1, "needle hay"), (2, "hay " * 50_000)])
    assert search.ranked(frame(docs).where("false"), queries).collect() == []
    assert search.ranked(frame(docs), queries.where("false")).collect() == []
    assert search.ranked(frame(docs), queries.where("false")).columns == ["item_id", "rank", "doc_id", "score"]
