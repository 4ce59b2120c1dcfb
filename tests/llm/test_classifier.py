from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from snapdelta.llm import classifier

DATA = "/root/testdata/sf0.01"


def test_gradients_match_differences():
    rng = np.random.default_rng(2)
    x, first, y = rng.normal(size=(9, classifier.FEATURES)), np.array([0, 1, 4, 9]), np.array([1.0, 0.0, 1.0])
    model = classifier.learn([x[:1].astype(np.float32), x[1:4].astype(np.float32)], np.array([0, 1]))
    w = {k: v.copy() for k, v in model.weights.items()}

    def loss(w):
        p = classifier._forward(w, x, first)["score"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for name, slope in classifier._gradients(w, x, first, y).items():
        flat = w[name].ravel()
        for k in (0, len(flat) // 2):
            kept = flat[k]
            flat[k] = kept + 1e-5
            up = loss(w)
            flat[k] = kept - 1e-5
            down = loss(w)
            flat[k] = kept
            assert np.isclose((up - down) / 2e-5, slope.ravel()[k], rtol=1e-3, atol=1e-7), name


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    scores = classifier.scored(docs, classifier.fit(docs, labels))
    both = scores.join(labels, "doc_id").where("held_out").select("predicted", "quality").collect()
    assert np.mean([r.predicted == r.quality for r in both]) > 0.95
    again = classifier.scored(docs, classifier.fit(docs, labels))
    assert scores.exceptAll(again).isEmpty()


def test_passages_of_a_batch_equal_those_of_single_texts():
    texts = ["", None, "a b", " lead" + " w" * 130, "é" * 50, "X!! " * 64, "\n"]
    x, first = classifier.passages(pa.array(texts))
    assert np.diff(first).tolist() == [1, 1, 1, 3, 1, 1, 1]
    for k, text in enumerate(texts):
        alone, _ = classifier.passages(pa.array([text], pa.string()))
        assert np.allclose(alone, x[first[k] : first[k + 1]])


def test_labels_of_one_kind_nulls_and_empty_tables(frame, spark):
    docs = frame([(1, "a b"), (None, None), (2, ""), (2, "")]).withColumn("label", F.lit("x")).withColumn("score", F.lit(0))
    schema = "doc_id bigint, quality int"
    none = classifier.fit(docs, spark.createDataFrame([(None, 1), (1, None)], schema))
    assert [r.score for r in classifier.scored(docs, none).collect()] == [0.5] * 4
    learners = [i for i in range(9) if zlib.crc32(str(i).encode()) % 3 != 1]
    ones = classifier.fit(frame([(i, "text") for i in learners]), spark.createDataFrame([(i, 1) for i in learners], schema))
    assert {r.score for r in classifier.scored(docs, ones).collect()} == {1.0}
    assert classifier.scored(frame([]), none).count() == 0


def test_sample_is_bounded(frame, spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1]
    docs = frame([(i, "the good text of a day" if i % 2 else "### $$$ !!!") for i in ids])
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id bigint, quality int")
    got = classifier.scored(docs, classifier.fit(docs, labels, sample=100)).collect()
    assert all(r.predicted == r.doc_id % 2 and 0 <= r.score <= 1 for r in got)
