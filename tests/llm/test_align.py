from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from snapdelta.llm import align
from snapdelta.llm.queries import QUERIES

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


@pytest.fixture(scope="module")
def pair():
    return align.Pair(*align.token_files())


def brute(pair, rows):
    """All figures by walking both token lists of each text."""
    first, second = pair.whole, pair.second
    spell = lambda table, ids: [table.data[table.begin[i] : table.begin[i + 1]].tobytes() for i in ids]
    found, counts = [], Counter()
    for doc_id, text in rows:
        a = first.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        want = f" {text}".encode() if text else b""
        if b"".join(spell(pair.a, a)) != want or b"".join(spell(pair.b, b)) != want:
            a, b = [], []
        ends = []
        for table, ids in ((pair.a, a), (pair.b, b)):
            at, own = 0, []
            for token in spell(table, ids):
                at += len(token)
                own.append(at)
            ends.append(own)
        common = set(ends[0]) & set(ends[1])
        groups, links = [], []
        i = j = 0
        for end in sorted(common):
            p, q = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
            groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
            links.append((a[p - 1], b[q - 1]))
            i, j = p, q
        counts.update(links)
        found.append((doc_id, len(a), len(b), len(groups), links, ";".join(groups)))
    highest = {}
    for (_, b), n in counts.items():
        highest[b] = max(n, highest.get(b, 0))
    return [
        (d, na, nb, ng, len(ls), sum(counts[x] == highest[x[1]] for x in ls), sum(counts[x] for x in ls), text) for d, na, nb, ng, ls, text in found
    ]


def texts():
    rng = random.Random(5)
    letters = "abcdefgh  éß漢字🙂\t\n0123456789<|>_-▁ﬁ\u0000​"
    rows = [None, "", " ", "one", "one", "  two  spaces", "x▁y", "<|endoftext|> and <s> <0x41>", "漢字かな🙂", "a\u0000b", "﻿x", "ﬁne"]
    rows += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 90))) for _ in range(60)]
    words = ["alpha", "Beta", "gamma,", "été", "naïve", "delta-epsilon", "漢字", "1234567"]
    rows += [" ".join(rng.choice(words) for _ in range(n)) for n in (5, 50, 3_000)]
    return list(enumerate(rows))


@pytest.mark.parametrize("work", [7, 64, align.PIECE])
def test_equals_brute_force(spark, frame, pair, work):
    rows = texts()
    found = align.aligned(frame(rows), *align.token_files(), work=work)
    assert found.columns == COLUMNS
    assert sorted(map(tuple, found.collect())) == brute(pair, rows)


def test_query_equals_brute_force(spark, pair):
    sf_dir = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = QUERIES["op11_token_alignment"](spark, sf_dir)
    expected = [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in brute(pair, sorted(rows))]
    assert sorted(map(tuple, found.collect())) == expected


def test_diagonal_cuts_divide_the_merge():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = (np.unique(rng.integers(1, 60, rng.integers(0, 40))) for _ in range(2))
        cuts = align.diagonal_cuts(a, b, 6)
        assert cuts[0] == (0, 0) and cuts[-1] == (len(a), len(b))
        for (i, j), (p, q) in zip(cuts, cuts[1:]):
            assert i <= p and j <= q and p - i + q - j <= 7
            # Everything before a cut lies at or before everything after it, and equal ends are on one side.
            assert not (p and q < len(b)) or a[p - 1] < b[q]
            assert not (q and p < len(a)) or b[q - 1] < a[p]


def test_nulls_repeats_and_other_columns(spark, pair):
    rows = [(None, "one two"), (None, "one two"), (3, None), (3, "one two three")]
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id bigint, text string, key int, pair string, n_a int")
    found = sorted(map(tuple, align.aligned(docs, *align.token_files()).collect()), key=repr)
    assert found == sorted(brute(pair, rows), key=repr)


def test_empty_table(spark, frame):
    assert align.aligned(frame([(1, "x")]).where("false"), *align.token_files()).collect() == []


def test_very_long_text(spark, frame, pair):
    rng = random.Random(1)
    long = " ".join(rng.choice(["spark", "tables", "été", "x1"]) for _ in range(200_000))
    rows = [(1, long), (2, "spark tables"), (3, "z" * 60_000)]
    found = align.aligned(frame(rows), *align.token_files()).withColumn("groups", F.sha2("groups", 256)).collect()
    expected = [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest()) for r in brute_fast(pair, rows)]
    assert sorted(map(tuple, found)) == expected


def brute_fast(pair, rows):
    """``brute`` without its list searches, for long texts."""
    first, second = pair.whole, pair.second
    walked, counts = [], Counter()
    for doc_id, text in rows:
        a, b = first.encode(f" {text}", add_special_tokens=False).ids, second.encode(text)
        groups, links, i, j, at_a, at_b, open_ = [], [], 0, 0, 0, 0, [[], []]
        while i < len(a) or j < len(b):
            if at_a <= at_b:
                at_a += int(pair.a.sizes[a[i]])
                open_[0].append(a[i])
                i += 1
            else:
                at_b += int(pair.b.sizes[b[j]])
                open_[1].append(b[j])
                j += 1
            if at_a == at_b:
                groups.append("|".join(",".join(map(str, side)) for side in open_))
                links.append((open_[0][-1], open_[1][-1]))
                open_ = [[], []]
        counts.update(links)
        walked.append((doc_id, len(a), len(b), len(groups), links, ";".join(groups)))
    highest = {}
    for (_, b), n in counts.items():
        highest[b] = max(n, highest.get(b, 0))
    return [(d, na, nb, ng, len(ls), sum(counts[x] == highest[x[1]] for x in ls), sum(counts[x] for x in ls), t) for d, na, nb, ng, ls, t in walked]


def test_both_forms_of_a_agree_on_every_character(pair):
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(letters), 50_000):
        texts = [f" a{c}b {c}1" for c in letters[k : k + 50_000]]
        assert [e.ids for e in pair.whole.encode_batch(texts, add_special_tokens=False)] == pair.first.encode_ordinary_batch(texts)


def test_words_alone_give_the_pieces_of_the_text(pair):
    rng = random.Random(8)
    letters = "abé漢 🙂1-_<>'\t\n."
    for _ in range(3_000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 40)))
        assert pair._ids_b(text).tolist() == pair.second.encode(text)
    # No piece has a blank behind another character, so none can span two words.
    pieces = [pair.second.id_to_piece(i) for i in range(pair.second.get_piece_size())]
    assert not [p for p in pieces if "\u2581" in p.lstrip("\u2581")]


def test_texts_that_one_form_may_refuse(pair):
    for text in ("x" * 300_000, " " * 300_000, "\n" * 100_000 + "x"):
        assert pair._ids_a(text).tolist() == pair.whole.encode(text, add_special_tokens=False).ids
