from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from snapdelta.llm import repeats
from snapdelta.llm.runindex import RunIndex


def brute(rows, length=100):
    """Spans and remaining bytes per text in order of ids, from a plain set of windows."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            window = data[i : i + length]
            if window in seen:
                gone[i : i + length] = True
            seen.add(window)
        edges = np.diff(np.concatenate(([0], gone.astype(int), [0])))
        spans = list(zip(np.flatnonzero(edges > 0).tolist(), np.flatnonzero(edges < 0).tolist()))
        out[doc_id] = (len(data), spans, np.frombuffer(data, np.uint8)[~gone].tobytes())
    return out


def planted():
    rng = random.Random(12)
    fresh = lambda n: "".join(rng.choice("abcdé fgh\n") for _ in range(n))
    passages = [fresh(rng.randint(90, 400)) for _ in range(6)]
    texts = [None, "", "short", "x" * 99, "x" * 100, "x" * 350, "xy" * 120, fresh(9_000)]
    for _ in range(60):
        texts.append(fresh(rng.randint(0, 300)) + rng.choice(passages)[rng.randint(0, 60) :] + fresh(rng.randint(0, 300)))
    texts += texts[10:25] + [texts[30][:200] + "!" + texts[30][200:], passages[0] * 3]
    return list(enumerate(texts))


def answers(frame_rows):
    return {r.doc_id: (r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in frame_rows.collect()}


def test_matches_brute_force_over_many_blocks(frame):
    rows = planted()
    got = answers(repeats.deduplicated(frame(rows), block_bytes=3_000, bucket_bytes=6_000, index_bytes=2_000))
    assert got == brute(rows)


@pytest.mark.parametrize("length", [24, 60, 139])
def test_other_lengths_in_one_block(frame, length):
    rows = planted()
    assert answers(repeats.deduplicated(frame(rows), length=length)) == brute(rows, length)


def test_hot_passage_with_distinct_surroundings(frame):
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(150))
    rows = [(i, "".join(rng.choice("ijklmnop ") for _ in range(40)) + passage + "".join(rng.choice("qrstuv ") for _ in range(30))) for i in range(250)]
    assert answers(repeats.deduplicated(frame(rows, 8), block_bytes=5_000, bucket_bytes=20_000)) == brute(rows)


def test_segments_do_not_depend_on_where_texts_are_cut(monkeypatch):
    data = np.frombuffer(("the quick brown fox " * 40 + "a" * 300).encode(), np.uint8)
    at = np.array([0, 500, len(data)])
    windows = lambda: [(f + k, h) for f, l, h in zip(*repeats.segments(data, at)) for k in range(l - f + 1)]  # noqa: E731, E741
    whole = windows()
    monkeypatch.setattr(repeats, "_SEGMENT", 61)
    assert windows() == whole


def test_run_index_against_plain_search():
    rng = random.Random(3)
    for _ in range(80):
        base = bytes(rng.choice(b"ab") for _ in range(60))
        texts = [base[(a := rng.randint(0, 50)) : a + rng.randint(0, 40)] + bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 10))) for _ in range(rng.randint(1, 12))]
        index = RunIndex(np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts], np.int64))
        length, seen, want = rng.choice([1, 3, 9, 20]), set(), []
        for k, text in enumerate(texts):
            for i in range(len(text) - length + 1):
                want.append((int(index.begins[k]) + i, text[i : i + length] not in seen))
                seen.add(text[i : i + length])
        at, first = index.first_occurrences(length)
        assert list(zip(at.tolist(), first.tolist())) == want


def test_repetitive_texts_have_few_samples():
    text = bytes(random.Random(1).choice(b"abcd") for _ in range(400))
    index = RunIndex(np.frombuffer(text * 30, np.uint8), np.full(30, 400, np.int64))
    assert index.runs < index.n / 8


def test_nulls_repeats_and_clashing_columns(frame):
    text = "".join(chr(97 + i * i % 26) + str(i) for i in range(80))
    rows = [(3, text), (3, text), (None, text), (4, "z" + text), (5, None)]
    docs = frame(rows).withColumn("kept", F.lit(1)).withColumn("block", F.lit("b")).withColumn("tie", F.lit(None).cast("int"))
    got = sorted(((r.doc_id, len(r.kept), len(r.spans)) for r in repeats.deduplicated(docs).collect()), key=repr)
    assert got == sorted([(None, len(text), 0), (3, 0, 1), (3, 0, 1), (4, 1, 1), (5, 0, 0)], key=repr)
    assert repeats.deduplicated(frame([])).count() == 0
    with pytest.raises(ValueError):
        repeats.deduplicated(docs, length=10)


def test_anchors_are_dealt_evenly_over_the_buckets():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 123, 60_000).astype(np.uint8)
    _, _, anchor = repeats.segments(data, np.array([0, len(data)]))
    sizes = np.diff(repeats._buckets(np.unique(anchor), 16))
    assert len(sizes) == 16 and sizes.max() <= 2 * sizes.mean()


def test_a_block_searches_its_answers_once_however_many_buckets_there_are(monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(100, 900))) for _ in range(30)]
    table = pa.table({"doc_id": pa.array(range(30), pa.int64()), "tie": pa.array(range(30), pa.int64()), "text": texts})
    block = repeats.Block(table, 100)
    keys, times = np.unique(block.anchor, return_counts=True)
    asked, searched, search = keys[::3], [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *more, **named: searched.append(np.size(v)) or search(a, v, *more, **named))

    def cost(buckets):
        at = repeats._buckets(asked, buckets)
        packs = [asked[a:b].tobytes() for a, b in zip(at[:-1], at[1:]) if a < b] + [None]
        answers = pa.table([pa.array([0] * len(packs), pa.int32()), pa.array(packs[::-1], pa.binary())], ["block", "keys"])
        searched.clear()
        found = repeats._repeated(block, answers)
        assert found.tolist() == np.isin(block.anchor, np.union1d(asked, keys[times > 1])).tolist()
        return sum(searched)

    assert cost(400) == cost(1) <= len(block.anchor)


def test_only_windows_whose_hash_comes_again_are_indexed():
    rng = random.Random(8)
    shared = bytes(rng.choice(b"abc") for _ in range(130))
    texts = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 30))) + shared[rng.randint(0, 40) : rng.randint(90, 130)] for _ in range(12)]
    texts = [t for t in texts if len(t) >= 60] + [b"x" * 60, b"y" * 64, b"z" + shared[5:66]]
    windows = [[t[i : i + 60] for i in range(len(t) - 59)] for t in texts]
    every = [w for of in windows for w in of]
    again = [[i for i, w in enumerate(of) if every.count(w) > 1] for of in windows]
    sizes = np.array([len(t) for t in texts])
    first, end = repeats._again(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes) - sizes, sizes, 60)
    assert any(again) and not all(again)
    assert list(zip(first.tolist(), end.tolist())) == [(a[0], a[-1] + 1) if a else (0, 0) for a in again]


def test_copies_in_a_block_send_no_segments():
    rng = random.Random(7)
    text = "".join(rng.choice("abcdefgh ") for _ in range(700))
    rows = pa.table({"doc_id": pa.array([4, None, 2, 4, 9], pa.int64()), "tie": pa.array([1, 1, 1, 1, 2], pa.int64()), "text": [text] * 4 + ["short"], "block": pa.array([0] * 5, pa.int32())})
    nothing = pa.table([pa.array([], pa.int32()), pa.array([], pa.binary())], ["block", "keys"])
    assert repeats._sends(rows, nothing, 4, 100).num_rows == 0
    for name in ("ranks", "starts", "low", "high"):
        nothing = nothing.append_column(name, pa.array([], pa.binary()))
    found = repeats._removes(rows, nothing, 100)
    got = sorted(((r["doc_id"], len(r["spans"]), r["kept"]) for r in found.to_pylist()), key=repr)
    assert got == sorted([(None, 0, text.encode()), (2, 1, b""), (4, 1, b""), (4, 1, b""), (9, 0, b"short")], key=repr)


def test_frequent_and_rare_copies_over_several_blocks(frame):
    rng = random.Random(15)
    fresh = lambda n: "".join(rng.choice("abcdé fgh\\n") for _ in range(n))
    rare, frequent = [fresh(rng.randint(80, 400)) for _ in range(30)], [fresh(900), fresh(99), ""]
    texts = rare * 2 + frequent * 60 + [frequent[0][300:] + rare[3] + fresh(50), fresh(2_000)]
    rng.shuffle(texts)
    docs = frame(list(enumerate(texts)))
    tied = docs.select(F.xxhash64("text").alias("tie"), "text")
    size, heavy = repeats._sizes(tied, 20_000 // 16)
    assert size == sum(len(t.encode()) for t in texts)
    assert sorted(heavy) == sorted(r.tie for r in tied.distinct().collect() if r.text in frequent)
    assert answers(repeats.deduplicated(docs, block_bytes=20_000, bucket_bytes=10_000)) == brute(list(enumerate(texts)))


def test_an_empty_text_between_removed_ones_has_no_span(frame):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh ") for _ in range(300))
    rows = list(enumerate([text, "q" + text, "", text[:250], None, text[10:]]))
    assert answers(repeats.deduplicated(frame(rows))) == brute(rows)
