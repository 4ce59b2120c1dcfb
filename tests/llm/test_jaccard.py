from __future__ import annotations

import random
import re

import numpy as np
import pytest

from snapdelta.llm import jaccard
from snapdelta.llm.queries import QUERIES

GAP = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def shingles(text, width=4):
    words = GAP.findall((text or "").translate(LOWER))
    return frozenset(zip(*[words[k:] for k in range(width)])) if len(words) >= width else (frozenset([tuple(words)]) if words else frozenset())


def brute(rows):
    """Components over all pairs that share a shingle; rows of (id, text)."""
    sets = [shingles(t) for _, t in rows]
    holding = {}
    for i, s in enumerate(sets):
        for x in s:
            holding.setdefault(x, []).append(i)
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        near = {j for x in s for j in holding[x] if j < i}
        for j in near:
            common = len(s & sets[j])
            if 100 * common >= 85 * (len(s) + len(sets[j]) - common):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return sorted(((d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(40)}"
    return words


def planted(seed):
    """Chains, stars, near misses that share their edits, passages that many share, and short texts."""
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(300)}" for _ in range(n)]
    texts = [None, "", " \n", "one", "ONE", "two words", "Two\tWords", "a b c d", "A b  c D", "a b c d e"]
    for _ in range(4):
        now = fresh(150)
        for _ in range(10):
            texts.append(" ".join(now))
            now = edited(rng, now, 2)
    base = fresh(200)
    texts += [" ".join(edited(rng, base, rng.randint(0, 12))) for _ in range(120)]
    common = fresh(60)
    texts += [" ".join(common + fresh(rng.randint(0, 30))) for _ in range(60)]
    texts += [" ".join(fresh(rng.randint(1, 80))) for _ in range(60)]
    texts += [texts[20]] * 30
    rng.shuffle(texts)
    return list(enumerate(texts))


def result(found):
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted(map(tuple, found.collect()), key=repr)


@pytest.mark.parametrize("seed,leaf_rows", [(1, jaccard.LEAF_ROWS), (2, 12), (3, 40)])
def test_equals_brute_force(spark, frame, seed, leaf_rows):
    rows = planted(seed)
    assert result(jaccard.clustered(frame(rows), leaf_rows=leaf_rows)) == brute(rows)


def test_pairs_just_at_the_threshold(spark, frame):
    rng = random.Random(9)
    rows = []
    for n in (20, 40, 100, 300):
        for away in range(1, n // 4):
            words = [f"t{n}x{away}x{k}" for k in range(n)]
            other = words[: n - away] + [f"u{rng.random()}" for _ in range(away)]
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(other))]
    found = result(jaccard.clustered(frame(rows)))
    assert found == brute(rows)
    assert 0 < sum(r[2] != r[0] for r in found) < len(rows) / 2


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_equals_brute_force(spark, sf):
    sf_dir = f"/root/testdata/sf{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert result(QUERIES["op13_ngram_jaccard_join"](spark, sf_dir)) == brute(rows)


def test_nulls_repeats_and_other_columns(spark):
    rows = [(None, "a b c d e"), (None, "a b c d e"), (7, "a b c d e"), (7, "x y z"), (3, None), (3, "x y z"), (None, "alone here"), (9, "x y z")]
    docs = spark.createDataFrame([(i, t, 1, "p", 2) for i, t in rows], "doc_id bigint, text string, node int, prefix string, component int")
    assert result(jaccard.clustered(docs)) == brute(rows)


def test_empty_table(spark, frame):
    assert result(jaccard.clustered(frame([(1, "x")]).where("false"))) == []


def test_very_long_texts(spark, frame):
    rng = random.Random(4)
    long = [f"w{rng.randrange(10**5)}" for _ in range(60_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[: 55_000])), (3, " ".join(long[:50_000])), (4, "x" * 500_000)]
    assert result(jaccard.clustered(frame(rows))) == brute(rows)


def test_regions_compare_few_pairs():
    """Groups around different texts are told apart by their pivots, and copies within a radius need no pair each."""
    rng = random.Random(5)
    sets = []
    for _ in range(16):
        base = rng.sample(range(10**6), 200)
        for _ in range(40):
            sets.append(np.unique(np.array(base[: 200 - rng.randint(0, 8)] + rng.sample(range(10**6, 2 * 10**6), rng.randint(0, 8)), np.uint64)))
    rng.shuffle(sets)
    region = jaccard.Region(sets, np.arange(len(sets)))
    region.join(np.arange(len(sets)))
    assert len(set(region.root)) == 16
    assert region.compared < len(sets) ** 2 / 4


def test_linked_sets_share_a_signature():
    """Pairs of every size at the threshold, differences spread at random, against the count of equal signatures."""
    rng = np.random.default_rng(11)
    least, of = jaccard.SIMILARITY
    for n in [*range(1, 60), 97, 150, 301, 800]:
        for _ in range(12):
            extra = int(rng.integers(0, n // 3 + 2))
            lost = int(rng.integers(0, n // 4 + 1))
            pool = rng.integers(1, 2**63, n + extra, dtype=np.uint64) * np.uint64(2)
            a, b = np.unique(pool[:n]), np.unique(pool[lost:])
            common = len(np.intersect1d(a, b))
            if len(b) and not np.array_equal(a, b) and jaccard.linked(common, len(a), len(b), (least, of)):
                assert np.intersect1d(jaccard.signatures(a, (least, of)), jaccard.signatures(b, (least, of))).size


def test_size_ranges_hold_linked_sizes():
    for n in range(1, 2_000):
        number, last = jaccard.size_range(n, (85, 100))
        assert n <= last and jaccard.size_range(last + 1, (85, 100))[0] == number + 1
        assert jaccard.size_range(n * 100 // 85, (85, 100))[0] <= number + 1
