from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from snapdelta.llm import lines


def brute(rows, run):
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        own = (text or "").split("\n")
        gone = set()
        for i in range(len(own) - run + 1):
            window = tuple(own[i : i + run])
            if window in seen:
                gone |= set(range(i, i + run))
            seen.add(window)
        spans = []
        for i in sorted(gone):
            if spans and spans[-1][1] == i:
                spans[-1][1] = i + 1
            else:
                spans.append([i, i + 1])
        out[doc_id] = (len(own), [tuple(s) for s in spans], "\n".join(x for i, x in enumerate(own) if i not in gone))
    return out


def planted():
    rng = random.Random(9)
    pool = [f"line {i}" for i in range(25)] + ["", "hot"]
    texts = [None, "", "\n", "hot\nhot\nhot\nhot\nhot"]
    texts += ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 14))) for _ in range(120)]
    return list(enumerate(texts + texts[20:40]))


@pytest.mark.parametrize("run", [1, 2, 3, 5])
def test_matches_brute_force(frame, run):
    rows = planted()
    got = {r.doc_id: (r.n_lines, [(x["first"], x["end"]) for x in r.runs], r.text) for r in lines.deduplicated(frame(rows), run=run).collect()}
    assert got == brute(rows, run)


def test_nulls_repeats_and_clashing_columns(frame):
    text = "a\nb\nc\nd"
    rows = [(2, text), (2, text), (None, text), (None, None), (3, "x\n" + text)]
    docs = frame(rows).withColumn("line", F.lit("own")).withColumn("name", F.lit(1)).withColumn("runs", F.lit(0))
    got = sorted(((r.doc_id, r.text) for r in lines.deduplicated(docs).collect()), key=repr)
    assert got == sorted([(2, ""), (2, ""), (None, text), (None, ""), (3, "x")], key=repr)
    assert lines.deduplicated(frame([])).count() == 0
    with pytest.raises(ValueError):
        lines.deduplicated(docs, run=0)


def test_long_passages_in_one_or_two_lines(frame):
    long = " ".join(f"word{i}" for i in range(60))
    first, second = " ".join(f"left{i}" for i in range(30)), " ".join(f"right{i}" for i in range(30))
    short = " ".join(f"few{i}" for i in range(49))
    rows = [
        (1, f"a\n{long}\nb"),
        (2, f"c\n{long}\n{long}\nd"),
        (3, f"{first}\n{second}\n{short}"),
        (4, f"e\n{first}\n{second}\nf\n{short}"),
        (5, f"{second}\n{first}"),
        (6, long),
    ]
    got = {r.doc_id: (r.text, [(x["first"], x["end"]) for x in r.runs]) for r in lines.deduplicated(frame(rows)).collect()}
    assert got == {
        1: (rows[0][1], []),
        2: ("c\nd", [(1, 3)]),
        3: (rows[2][1], []),
        4: (f"e\nf\n{short}", [(1, 3)]),
        5: (rows[4][1], []),
        6: ("", [(0, 1)]),
    }


@pytest.mark.parametrize("run", [1, 2, 3, 5])
def test_long_passages_match_brute_force(frame, run):
    rows = planted()
    own = {i: (t or "").split("\n") for i, t in rows}
    gone = {i: set() for i in own}
    for width in range(1, run + 1):
        seen = set()
        for i in sorted(own):
            for k in range(len(own[i]) - width + 1):
                window = tuple(own[i][k : k + width])
                if width < run and sum(len(x.split()) for x in window) < 4:
                    continue
                if window in seen:
                    gone[i] |= set(range(k, k + width))
                seen.add(window)
    got = {r.doc_id: r.text for r in lines.deduplicated(frame(rows), run=run, long_words=4).collect()}
    assert got == {i: "\n".join(x for k, x in enumerate(own[i]) if k not in gone[i]) for i in own}
