from __future__ import annotations

import random

import pytest

from snapdelta.llm import components as module
from snapdelta.llm.components import components, sharing


def plain(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def graphs():
    rng = random.Random(3)
    mixed = list(range(60))
    rng.shuffle(mixed)
    return {
        "none": [],
        "path": list(zip(range(59), range(1, 60))),
        "shuffled path": list(zip(mixed, mixed[1:])),
        "star of the greatest": [(59, i) for i in range(40)] + [(7, 7), (7, 59)],
        "random": [(rng.randrange(60), rng.randrange(60)) for _ in range(45)],
    }


@pytest.mark.parametrize("name", graphs())
def test_components_of(spark, name):
    links = graphs()[name]
    frame = spark.createDataFrame([(n,) for n in range(60)], "node bigint")
    found = components(frame, spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert len(found) == 60 and {r.node: r.component for r in found} == plain(range(60), links)


@pytest.fixture
def written(monkeypatch):
    """Rows of each step that components write, by name."""
    rows: dict[str, list[int]] = {}
    settled = module.settled

    def counted(df, name):
        out = settled(df, name)
        rows.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(module, "settled", counted)
    return rows


def test_a_link_is_read_once_and_not_in_every_round(spark, written):
    rng = random.Random(4)
    links = sorted({(a, b) for a in range(80) for b in range(a) if rng.random() < 0.6})
    components(spark.range(80).withColumnRenamed("id", "node"), spark.createDataFrame(links, "a bigint, b bigint"))
    assert sum(written["links"]) < 1.1 * len(links)


def test_sharing_makes_no_link_per_node_and_group(spark, written):
    rng = random.Random(5)
    members = [(n, g) for g in range(120) for n in rng.sample(range(100), 30)] + [(n, 1_000 + n // 3) for n in range(200, 215)]
    found = sharing(spark.createDataFrame(members, "node bigint, signature bigint"), ["signature"]).collect()
    of: dict[int, list[int]] = {}
    for n, g in members:
        of.setdefault(g, []).append(n)
    assert {r.node: r.component for r in found} == plain({n for n, _ in members}, [(ns[0], n) for ns in of.values() for n in ns])
    assert len(found) == 115 and sum(written["links"]) <= 2 * len(found)
