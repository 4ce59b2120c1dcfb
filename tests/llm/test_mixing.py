from __future__ import annotations

import hashlib
import math
import random
from collections import defaultdict

from pyspark.sql import functions as F

from snapdelta.llm import mixing


def fill(given, nodes):
    """Shares of ``given`` by weight; full nodes hand on what they cannot take. nodes: name -> (capacity, weight)."""
    open_, out, left = dict(nodes), {}, given
    while open_:
        total = sum(w for _, w in open_.values())
        full = [k for k, (c, w) in open_.items() if c <= left * w / total + 1e-9]
        if not full:
            for k, (_, w) in open_.items():
                out[k] = left * w / total
            return out
        for k in full:
            out[k] = float(open_.pop(k)[0])
        left = given - sum(out.values())
    return out


def brute(rows, mix):
    source_domain = {s: d for d, ss in mix.domains.items() for s in ss}
    leaf = lambda r: (source_domain.get(r[3] or "", "other"), r[2] or "", r[3] or "")
    tokens = lambda r: len((r[1] or "").split())
    weight = lambda level, name: mix.weights.get(level, {}).get(name, mix.default_weight)
    supply = defaultdict(int)
    for r in rows:
        supply[leaf(r)] += tokens(r)
    asked = mix.budget_tokens if mix.budget_tokens is not None else mix.budget_share * sum(supply.values())
    given = {(): min(asked, sum(supply.values()) * mix.max_epochs)}
    for depth, level in enumerate(mixing.LEVELS):
        following = {}
        for path, amount in given.items():
            children = defaultdict(int)
            for k, n in supply.items():
                if k[:depth] == path:
                    children[k[depth]] += n * mix.max_epochs
            nodes = {k: (c, weight(level, k)) for k, c in children.items() if weight(level, k) > 0}
            following |= {(*path, k): v for k, v in fill(amount, nodes).items()}
        given = following
    out = {}
    for path, amount in given.items():
        budget = math.floor(amount + 1e-6)
        epochs = budget // supply[path] if supply[path] else 0
        rest, before = budget - epochs * supply[path], 0
        own = [r for r in rows if leaf(r) == path]
        for r in sorted(own, key=lambda r: hashlib.md5(f"{mix.seed}:{epochs}:{r[0]}".encode()).hexdigest()):
            out[r[0]] = (budget, epochs + (before < rest))
            before += tokens(r)
    return out


def rows_of(n, seed=2):
    rng = random.Random(seed)
    return [
        (i, " ".join("w" for _ in range(rng.randint(0, 40))), rng.choice(["en", "en", "de", "fr", None]), rng.choice(["src0", "src0", "src1", "src9", "src15", "elsewhere", None]), 0)
        for i in range(n)
    ]


def test_matches_brute_force(frame):
    rows = rows_of(300)
    for mix in (mixing.Mix(), mixing.Mix(budget_share=1.7, max_epochs=3), mixing.Mix(budget_tokens=900, seed=3)):
        got = {r.doc_id: (r.budget, r.times) for r in mixing.drawn(frame(rows), mix).collect()}
        assert got == brute(rows, mix)


def test_short_leaf_is_filled_by_its_siblings_first(frame):
    words = lambda n: " ".join("w" for _ in range(n))
    rows = [(0, words(10), "en", "src0", 0)] + [(i, words(10), "de", "src0", 0) for i in range(1, 50)] + [(i, words(10), "en", "src9", 0) for i in range(50, 99)]
    mix = mixing.Mix(weights={}, budget_tokens=400, max_epochs=1)
    taken = defaultdict(int)
    for r in mixing.drawn(frame(rows), mix).collect():
        taken[(r.domain, r.lang)] += r.times * r.n_tokens
    assert taken == {("core", "en"): 10, ("core", "de"): 190, ("wide", "en"): 200}


def test_rows_are_repeated_and_columns_kept(frame):
    rows = rows_of(80)
    docs = frame(rows).withColumn("times", F.lit("own")).withColumn("place", F.lit(1)).withColumn("budget", F.lit(None).cast("int"))
    mix = mixing.Mix(budget_share=1.5, max_epochs=2)
    out = mixing.mixed(docs, mix)
    assert out.columns == docs.columns
    counts = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {k: t for k, (_, t) in brute(rows, mix).items() if t}


def test_weight_zero_nulls_and_repeats(frame):
    rows = [(None, "a b", None, None, None), (1, None, "en", "src0", None), (1, "x y z", "en", "src0", 0), (1, "x y z", "en", "src0", 0)]
    got = mixing.drawn(frame(rows), mixing.Mix(budget_share=1.0, max_epochs=1, weights={"source": {"src0": 0.0}})).collect()
    assert sorted((r.source, r.times) for r in got) == [("", 1), ("src0", 0), ("src0", 0), ("src0", 0)]
    assert mixing.drawn(frame([])).count() == 0
    assert mixing.mixed(frame([])).count() == 0
