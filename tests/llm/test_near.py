from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import functions as F

from snapdelta.llm import components, jaccard, near, wordhash
from snapdelta.llm.queries import QUERIES

GAP = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def shingles(text, width):
    words = GAP.findall((text or "").translate(LOWER))
    return set(zip(*[words[k:] for k in range(width)])) if len(words) >= width else ({tuple(words)} if words else set())


def brute(rows, width=4):
    sets = {i: shingles(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def planted(seed=3):
    """Chains (each a copy of the one before), stars (copies of one text) and unrelated texts, with shared boilerplate."""
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    texts = [None, "", " \n", "one", "ONE", "two words", "Two\tWords", "a b c d", "A b  c D"]
    for _ in range(4):
        now = fresh(120)
        for _ in range(8):
            texts.append(" ".join(now))
            now = edited(rng, now, 2)
    base = fresh(150)
    texts += [" ".join(edited(rng, base, rng.randint(0, 5))) for _ in range(40)]
    common = fresh(60)
    texts += [" ".join(common + fresh(rng.randint(0, 80))) for _ in range(40)]
    texts += texts[20:30] + [" ".join(fresh(4_000))]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i * 3 + 1, texts[k]) for i, k in enumerate(order)]


def test_components_match_brute_force(frame):
    rows = planted()
    for words in (4, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near.clustered(frame(rows), words=words).collect()}
        assert got == brute(rows, words)


def test_sketch_fills_every_bin_and_estimates_similarity():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 40, 900, 20_000):
        assert (near.sketch(np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))) != near._FULL).all()
    errors = []
    for _ in range(200):
        pool = rng.integers(0, 2**63, 120, dtype=np.uint64)
        a, b = np.sort(pool[:110]), np.sort(pool[10:])
        errors.append((near.sketch(a) == near.sketch(b)).mean() - 100 / 120)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 1.3 * np.sqrt(100 / 120 * 20 / 120 / near.COORDINATES)


def test_words_match_a_plain_split():
    import pyarrow as pa

    texts = [None, "", " ", "Ab aB", "é\x0bÉ", "x" * 300, "x" * 299 + "y", "a\x85b c"]
    hashes, before = wordhash.words(*wordhash.texts_of(pa.array(texts)))
    names = {}
    for i, text in enumerate(texts):
        words = GAP.findall((text or "").translate(LOWER))
        own = hashes[before[i] : before[i + 1]].tolist()
        assert len(own) == len(words)
        for word, value in zip(words, own):
            assert names.setdefault(word, value) == value
    assert len(set(names.values())) == len(names)


def test_segments_of_long_texts_agree(monkeypatch):
    import pyarrow as pa

    texts = pa.array(["ab " * 500, "x" * 700, "", "c " + "y" * 90 + " d"])
    whole = wordhash.words(*wordhash.texts_of(texts))
    monkeypatch.setattr(wordhash, "_SEGMENT", 37)
    parts = wordhash.words(*wordhash.texts_of(texts))
    assert all((x == y).all() for x, y in zip(whole, parts))


def test_nulls_repeats_and_kept_rows(frame):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text), (4, text), (4, text), (2, text + " tail"), (9, None), (9, ""), (7, "x y")]
    docs = frame(rows).withColumn("component_id", F.lit("own")).withColumn("node", F.lit(1)).withColumn("kept", F.lit(False))
    got = sorted(map(tuple, near.clustered(docs).collect()), key=repr)
    assert got == sorted([(None, 27, None, True), (4, 27, 2, False), (4, 27, 2, False), (2, 28, 2, True), (9, 0, 9, True), (9, 0, 9, True), (7, 1, 7, True)], key=repr)
    kept = near.kept_rows(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == [2, 7, 9, 9, None]
    assert near.clustered(frame([])).count() == 0


def test_query_equals_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    sets = {i: shingles(t, 4) for i, t in rows}
    holding, parent = {}, {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(sets):
        for j in {j for s in sets[i] for j in holding.get(s, ())}:
            common = len(sets[i] & sets[j])
            if 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
        for s in sets[i]:
            holding.setdefault(s, []).append(i)
    want = {i: (len(sets[i]), root(i), root(i) == i) for i in sets}
    found = QUERIES["op2_minhash_near_dedup"](spark, sf_dir).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == want


def test_pairs_close_to_the_threshold_are_found(frame):
    """Pairs of 0.80 to 0.85, each on its own: none may be missed, and none below the threshold linked."""
    rng = random.Random(12)
    rows, alike = [], {}
    for k in range(400):
        words = [f"p{k}w{i}" for i in range(203)]
        # Words replaced at the end cost as many shingles and a few; 200 shingles, of which d differ: (200 - d) / (200 + d).
        d = rng.randint(17, 27)
        other = words[: 203 - d] + [f"q{k}w{i}" for i in range(d)]
        alike[2 * k + 1] = 100 * (200 - d) >= 80 * (200 + d)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    found = {r.doc_id: r.component_id for r in near.clustered(frame(rows)).collect()}
    assert {i: found[i] == i - 1 for i in alike} == alike and 100 < sum(alike.values()) < 400


def test_a_large_group_beside_near_misses(frame):
    """Copies joined by a few centres, and as many texts of the same base whose edits keep them just below the threshold."""
    rng = random.Random(13)
    base = [f"b{i}" for i in range(120)]
    texts = [" ".join(edited(rng, base, rng.randint(0, 3))) for _ in range(150)]
    texts += [" ".join(edited(rng, base, rng.randint(5, 8))) for _ in range(150)]
    rows = list(enumerate(texts))
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near.clustered(frame(rows)).collect()} == brute(rows)


def test_steps_are_few(frame, monkeypatch):
    """Each step is a shuffle of all partitions, however few rows there are; one round of stars is followed by the regions."""
    names = []
    for module in (near, components, jaccard):
        monkeypatch.setattr(module, "settled", lambda df, name, settled=module.settled: names.append(name) or settled(df, name))
    rows = planted()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near.clustered(frame(rows)).collect()} == brute(rows)
    assert len(names) <= 44 and names.count("near-links") == 2


def test_a_repeated_id_without_any_link(frame):
    texts = [" ".join(f"{c}{i}" for i in range(30)) for c in "ab"]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[0][:40] + " other words that differ here"), (3, "lone words of its own")]
    assert sorted((r.doc_id, r.component_id) for r in near.clustered(frame(rows)).collect()) == [(1, 1), (1, 1), (2, 2), (3, 3)]


def test_texts_without_a_candidate_are_not_moved(frame, monkeypatch):
    """Of texts alike in nothing few pass the filter at the scan, and the way of the others does not change with their number."""
    passed, plans = [], []
    monkeypatch.setattr(jaccard, "chosen", lambda rows, wanted, own=jaccard.chosen: passed.append(own(rows, wanted)) or passed[-1])
    monkeypatch.setattr(near, "_sets", lambda texts, words, own=near._sets: plans.append(texts._jdf.queryExecution().toString()) or own(texts, words))
    rows = [(i, " ".join(f"t{i}w{k}" for k in range(20))) for i in range(600)]
    rows += [(None, "t5w1 t5w2"), *((1_000 + i, text) for i, text in rows[:3]), *((2_000 + i, text + " more") for i, text in rows[:3])]
    found = {r.doc_id: r.component_id for r in near.clustered(frame(rows)).collect() if r.doc_id is not None}
    assert found == {i: i % 1_000 if i % 1_000 < 3 else i for i, _ in rows if i is not None}
    assert {0, 1, 2, 2_000, 2_001, 2_002} <= {r.node for r in passed[0].collect()}
    assert passed[0].count() < 120
    assert "SortMergeJoin" in plans[0] and "BroadcastHashJoin" not in plans[0]
