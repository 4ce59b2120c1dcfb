"""Registered queries without SQL, over the whole smallest table, against plain Python."""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from snapdelta.llm import bpe, classifier, wordhash
from snapdelta.llm.queries import QUERIES
from snapdelta.llm.quality import STOP_WORDS
from tests.llm.test_lm import brute as lm_brute
from tests.llm.test_lm import close
from tests.llm.test_repeats import brute as repeats_brute

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_op1(spark, rows):
    want = {i: (n, sum(b - a for a, b in spans), len(spans), sha(kept)) for i, (n, spans, kept) in repeats_brute(rows).items()}
    found = QUERIES["op1_suffix_dedup"](spark, DATA).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == want


def test_op5(spark, rows):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for doc_id, text in rows:
        ids = reference.encode_ordinary(text or "")
        want[doc_id] = (len(ids), sha(",".join(map(str, ids)).encode()), sha((text or "").encode()))
    found = QUERIES["op5_byte_bpe"](spark, DATA).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found} == want


def test_op7(spark, rows):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    found = sorted((tuple(r) for r in QUERIES["op7_lm_scoring"](spark, DATA).select(*names).collect()), key=repr)
    close(found, lm_brute(rows))


# Op 8: passages, forward pass and score by plain loops


def plain_passages(text):
    """Feature rows of one text, one word at a time."""
    data = (text or "").encode()
    words = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    stops = {w.encode() for w in STOP_WORDS}
    lower = lambda w: bytes(b + 32 if 65 <= b <= 90 else b for b in w)
    rows = []
    for low in range(0, max(1, len(words)), classifier.PASSAGE):
        own = words[low : low + classifier.PASSAGE]
        begin = own[0][0] if low else 0
        later = words[low + classifier.PASSAGE : low + classifier.PASSAGE + 1]
        part = data[begin : later[0][0] if later else len(data)]
        classes = [0.0] * 10
        for b in part:
            c = chr(b)
            kind = next(
                (k for k, here in enumerate((97 <= b < 123, 65 <= b < 91, 48 <= b < 58, b in (32, 9, 11, 12, 13), b == 10, c in "#*$%&|<>", c in "!?", c in ".,;:", b < 128)) if here), 9
            )
            classes[kind] += 1
        texts = [lower(data[a:b]) for a, b in own]
        n, many = max(1, len(texts)), max(1, len(part))
        hashes = [int(wordhash.words(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0][0]) for w in texts]
        bag = [0.0] * classifier.BAG
        for h in hashes:
            bag[h % classifier.BAG] += 1 if h >> 63 else -1
        rows.append(
            [x / many * 4 for x in classes]
            + [
                len(texts) / classifier.PASSAGE,
                min((many - classes[3] - classes[4]) / n / 8, 4),
                sum(w in stops for w in texts) / n * 4,
                sum(a == b for a, b in zip(texts, texts[1:])) / n * 4,
                len(set(texts)) / n,
                min(math.log1p(len(words)) / 8, 2),
            ]
            + [x / math.sqrt(n) / 4 for x in bag]
        )
    return rows


def plain_score(w, passages):
    """The gated attention layer, one passage and one unit at a time."""
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    hidden, heat = [], []
    for x in passages:
        h = [math.tanh(sum(a * b for a, b in zip(x, column)) + c) for column, c in zip(w["encode"].T, w["encode_b"])]
        side = [math.tanh(sum(a * b for a, b in zip(h, column))) for column in w["side"].T]
        gate = [sigmoid(sum(a * b for a, b in zip(h, column))) for column in w["gate"].T]
        hidden.append(h)
        heat.append(math.exp(sum(a * s * g for a, s, g in zip(w["attend"], side, gate))))
    pooled = [sum(e * h[k] for e, h in zip(heat, hidden)) / sum(heat) for k in range(len(hidden[0]))]
    return sigmoid(sum(a * b for a, b in zip(pooled, w["out"])) + w["out_b"][0])


def test_op8(spark, rows, monkeypatch):
    models, fit = [], classifier.fit
    monkeypatch.setattr(classifier, "fit", lambda *a, **k: models.append(fit(*a, **k)) or models[-1])
    found = {r.doc_id: r for r in QUERIES["op8_quality_classifier"](spark, DATA).collect()}
    assert len(found) == len(rows)
    for doc_id, text in sorted(rows, key=lambda r: len(r[1] or ""))[:150]:
        score = plain_score(models[0].weights, plain_passages(text))
        assert math.isclose(found[doc_id].score, score, rel_tol=1e-3, abs_tol=1e-5), doc_id
    for r in found.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5)


def test_op8_passages_of_odd_texts():
    import pyarrow as pa

    texts = ["", None, "a b", " lead" + " W!" * 130, "é" * 50, "X!! " * 64, "\n", "the The the\tder\n# $5.", "w " * 64]
    got, first = classifier.passages(pa.array(texts))
    for k, text in enumerate(texts):
        assert np.allclose(got[first[k] : first[k + 1]], plain_passages(text), atol=1e-5), text
