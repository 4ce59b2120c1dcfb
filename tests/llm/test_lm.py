from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from snapdelta.llm import lm

GAP = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def brute(rows):
    tokens = [GAP.findall((t or "").translate(LOWER)) + [None] for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    words, pairs, starts = Counter(), Counter(), 0
    for own, out in zip(tokens, held):
        if not out:
            words.update(own)
            pairs.update(zip(["<s>", *own], own))
            starts += 1
    total, kinds = sum(words.values()), len(words)
    after = {**words, "<s>": starts}
    result = []
    for (doc_id, _), own, out in zip(rows, tokens, held):
        base = sum(math.log10((words[w] + 1) / (total + kinds + 1)) for w in own)
        score = 0.0
        for before, w in zip(["<s>", *own], own):
            root = (1 - lm.UNKNOWN) * words[w] / total if words[w] else lm.UNKNOWN
            score += math.log10((pairs[before, w] + lm.KAPPA * root) / (after.get(before, 0) + lm.KAPPA))
        result.append((doc_id, out, len(own), sum(words[w] > 0 for w in own), total, base, score))
    return sorted(result, key=repr)


def rows_of(n=120):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(60)]
    out = [(None, None), (None, "w1 W1"), (0, ""), (1, " \n"), (3, "w3 " * 3_000)]
    for i in range(4, n):
        out.append((i, " ".join(rng.choice(vocabulary[: rng.randint(1, 60)]) for _ in range(rng.randint(0, 50))) + f" rare{i}"))
    return out + [(5, "w5 w6"), (5, "w5 w6")]


def close(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5]
        assert math.isclose(a[5], b[5], rel_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-9)


def test_scores_match_counts_over_many_blocks(frame, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 1_500)
    monkeypatch.setattr(lm, "BUCKET_BYTES", 4_000)
    rows = rows_of()
    close(sorted(map(tuple, lm.scored(frame(rows)).collect()), key=repr), brute(rows))


def test_one_block(frame):
    rows = rows_of(30)
    docs = frame(rows).withColumn("block", F.lit("own")).withColumn("score", F.lit(1)).withColumn("held_out", F.lit(2))
    close(sorted(map(tuple, lm.scored(docs).collect()), key=repr), brute(rows))


def test_every_state_adds_up_to_one():
    texts = pa.array(["a b a", "b a", "c", "a c c b"])
    tokens, starts = lm.tokens_of(texts)
    training = np.ones(len(tokens), bool)
    words, counts = lm._counted(tokens, training)
    arcs, arc_counts = lm._counted(lm.arcs_of(lm.contexts_of(tokens, starts), tokens), training)
    model = lm.Automaton(words, counts.astype(np.int64), arcs, arc_counts.astype(np.int64), 4, len(tokens))
    unknown = np.uint64(12345)
    for context in [*words[words != lm.END].tolist(), 999]:
        following = np.append(words, unknown)
        total = 0.0
        for word in following:
            _, weights = model.weights(np.array([context, word], np.uint64), np.array([0, 2]))
            total += 10 ** weights[1]
        assert math.isclose(total, 1.0, rel_tol=1e-12)


def test_held_out_texts_score_above_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    base, score = lm.scored(docs).where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert score > base


def test_no_training_texts_and_empty_table(frame):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    got = lm.scored(frame([(i, "a b") for i in held])).collect()
    assert all((r.train_tokens, r.n_known, r.n_tokens) == (0, 0, 3) for r in got) and len(got) == 3
    assert lm.scored(frame([])).count() == 0
