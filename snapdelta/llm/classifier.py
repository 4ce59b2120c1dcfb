"""Quality classifier by attention over a document's passages (multiple-instance learning).

A passage is ``PASSAGE`` words in a row, the last one shorter. Each is encoded from its bytes and words: shares of character
classes, word lengths, function words, repeated words and a small hashed bag of words. A gated attention layer weighs the encoded
passages, and the weighted mean is scored. Only document labels are known; what each passage counts for is learnt.

Learning uses at most ``SAMPLE`` labelled documents, those with the least hash of their id, with all their passages; the sample
is that bound whatever the data, so it is learnt on the driver. The weights, some thousand numbers, are sent to the tasks, which
score every document in whole. Labels, languages, sources and ids are no inputs of a score.

Defined results: a null or empty text is one passage without words and is scored as such. Null labels and labels of null ids
teach nothing; of several labels of one id the largest counts. With labels of one kind only, or none, every text gets the share of
label 1 (0.5 without labels). Repeated rows get equal scores. Extra columns are left out. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapdelta.llm import wordhash
from snapdelta.llm.quality import STOP_WORDS

PASSAGE = 64
SAMPLE = 6_000
BAG = 32
HIDDEN, GATE = 24, 12
EPOCHS, BATCH, RATE, DECAY = 12, 64, 0.01, 1e-4

# Character classes by byte: lower, upper, digit, blank, newline, symbols, shouting marks, stops, other ASCII, beyond ASCII.
_CLASSES = 10


def _byte_classes() -> np.ndarray:
    kinds = np.full(256, 8, np.int64)
    kinds[97:123], kinds[65:91], kinds[48:58] = 0, 1, 2
    kinds[[32, 9, 11, 12, 13]], kinds[10] = 3, 4
    kinds[[ord(c) for c in "#*$%&|<>"]] = 5
    kinds[[ord(c) for c in "!?"]] = 6
    kinds[[ord(c) for c in ".,;:"]] = 7
    kinds[128:] = 9
    return kinds


def _stop_hashes() -> np.ndarray:
    texts = pa.array([" ".join(STOP_WORDS)])
    return np.unique(wordhash.words(*wordhash.texts_of(texts))[0])


FEATURES = _CLASSES + 6 + BAG


def passages(column: pa.Array, size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages, and the number of passages before each text with the total last."""
    data, at = wordhash.texts_of(column)
    hashes, starts = wordhash.placed_words(data, at)
    before = np.searchsorted(starts, at, "left")
    per_text = np.maximum(1, -(-np.diff(before) // size))
    first = np.concatenate(([0], np.cumsum(per_text)))
    total = int(first[-1])
    of_word = np.repeat(np.arange(len(per_text)), np.diff(before))
    passage = first[of_word] + (np.arange(len(hashes)) - before[of_word]) // size
    words = np.bincount(passage, minlength=total).astype(np.float64)
    # A passage's bytes run from its first word to the next passage's; the first of a text starts with the text.
    begins = np.repeat(at[:-1], per_text)
    new = np.flatnonzero(np.diff(passage, prepend=-1) > 0)
    inner = (np.arange(len(hashes)) - before[of_word])[new] > 0
    begins[passage[new][inner]] = starts[new][inner]
    counts = np.zeros((total, _CLASSES))
    kinds = _byte_classes()
    step = 1 << 19
    for low in range(0, len(data), step):
        part = data[low : low + step]
        first_after, last_after = np.searchsorted(begins, [low, low + len(part) - 1], "right")
        edges = np.concatenate(([low], begins[first_after:last_after], [low + len(part)]))
        own = np.repeat(np.arange(first_after - 1, last_after), np.diff(edges))
        base = int(own[0])
        width = int(own[-1]) - base + 1
        counts[base : base + width] += np.bincount((own - base) * _CLASSES + kinds[part], minlength=width * _CLASSES).reshape(width, _CLASSES)
    many = np.maximum(counts.sum(1), 1)
    letters = many - counts[:, 3] - counts[:, 4]
    some = np.maximum(words, 1)
    stops = np.bincount(passage, np.isin(hashes, _stop_hashes()), minlength=total)
    same = np.zeros(len(hashes))
    if len(hashes):
        same[1:] = (hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1])
    order = np.lexsort((hashes, passage))
    fresh = np.ones(len(hashes))
    if len(hashes):
        h, p = hashes[order], passage[order]
        fresh[1:] = (h[1:] != h[:-1]) | (p[1:] != p[:-1])
    distinct = np.bincount(passage[order], fresh, minlength=total)
    bag = np.bincount(passage * BAG + (hashes % np.uint64(BAG)).astype(np.int64), np.where(hashes >> np.uint64(63), 1.0, -1.0), minlength=total * BAG)
    out = np.concatenate(
        [
            counts / many[:, None] * 4,
            np.stack(
                [
                    words / size,
                    np.minimum(letters / some / 8, 4),
                    stops / some * 4,
                    np.bincount(passage, same, minlength=total) / some * 4,
                    distinct / some,
                    np.repeat(np.minimum(np.log1p(np.diff(before)) / 8, 2), per_text),
                ],
                1,
            ),
            bag.reshape(total, BAG) / np.sqrt(some)[:, None] / 4,
        ],
        1,
    )
    return out.astype(np.float32), first


@dataclass
class Model:
    """Weights; ``prior`` alone is used where nothing could be learnt."""

    weights: dict[str, np.ndarray] | None
    prior: float = 0.5

    def score(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(first) - 1, self.prior)
        return _forward(self.weights, features, first)["score"]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _forward(w: dict, x: np.ndarray, first: np.ndarray) -> dict:
    hidden = np.tanh(x @ w["encode"] + w["encode_b"])
    side, gate = np.tanh(hidden @ w["side"]), _sigmoid(hidden @ w["gate"])
    logit = (side * gate) @ w["attend"]
    begins, sizes = first[:-1], np.diff(first)
    top = np.repeat(np.maximum.reduceat(logit, begins), sizes)
    heat = np.exp(logit - top)
    share = heat / np.repeat(np.add.reduceat(heat, begins), sizes)
    pooled = np.add.reduceat(hidden * share[:, None], begins, axis=0)
    score = _sigmoid(pooled @ w["out"] + w["out_b"][0])
    return {"hidden": hidden, "side": side, "gate": gate, "share": share, "pooled": pooled, "score": score}


def _gradients(w: dict, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict:
    f = _forward(w, x, first)
    begins, sizes = first[:-1], np.diff(first)
    error = (f["score"] - y) / len(y)
    d_pooled = np.repeat(error[:, None] * w["out"][None, :], sizes, 0)
    d_share = (d_pooled * f["hidden"]).sum(1)
    mean = np.repeat(np.add.reduceat(d_share * f["share"], begins), sizes)
    d_logit = f["share"] * (d_share - mean)
    d_side = d_logit[:, None] * w["attend"] * f["gate"] * (1 - f["side"] ** 2)
    d_gate = d_logit[:, None] * w["attend"] * f["side"] * f["gate"] * (1 - f["gate"])
    d_hidden = d_pooled * f["share"][:, None] + d_side @ w["side"].T + d_gate @ w["gate"].T
    d_in = d_hidden * (1 - f["hidden"] ** 2)
    return {
        "encode": x.T @ d_in,
        "encode_b": d_in.sum(0),
        "side": f["hidden"].T @ d_side,
        "gate": f["hidden"].T @ d_gate,
        "attend": (d_logit[:, None] * f["side"] * f["gate"]).sum(0),
        "out": f["pooled"].T @ error,
        "out_b": np.array([error.sum()]),
    }


def learn(features: list[np.ndarray], y: np.ndarray, seed: int = 5) -> Model:
    """Adam over shuffled batches of documents."""
    y = np.asarray(y, np.float64)
    if not len(y) or y.min() == y.max():
        return Model(None, float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    shape = {"encode": (FEATURES, HIDDEN), "encode_b": (HIDDEN,), "side": (HIDDEN, GATE), "gate": (HIDDEN, GATE), "attend": (GATE,), "out": (HIDDEN,), "out_b": (1,)}
    w = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if not k.endswith("_b") else np.zeros(s) for k, s in shape.items()}
    mean, spread, step = {k: np.zeros(s) for k, s in shape.items()}, {k: np.zeros(s) for k, s in shape.items()}, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for low in range(0, len(y), BATCH):
            chosen = order[low : low + BATCH]
            x = np.concatenate([features[i] for i in chosen]).astype(np.float64)
            first = np.concatenate(([0], np.cumsum([len(features[i]) for i in chosen])))
            step += 1
            for k, g in _gradients(w, x, first, y[chosen]).items():
                g = g + DECAY * w[k]
                mean[k] = 0.9 * mean[k] + 0.1 * g
                spread[k] = 0.999 * spread[k] + 0.001 * g * g
                rate = RATE * (1 - epoch / EPOCHS) + 1e-4
                w[k] = w[k] - rate * mean[k] / (1 - 0.9**step) / (np.sqrt(spread[k] / (1 - 0.999**step)) + 1e-8)
    return Model(w)


def held_out(key: Column, parts: int = 3, part: int = 1) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(parts)) == part


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` labelled documents outside the held-out part."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("__id"), "__id").limit(sample)
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(chosen), "__id").select("__id", "label", "text")  # ``sample`` rows at most

    def run(batches):
        for batch in batches:
            for part in wordhash.portions(batch, "text"):
                x, first = passages(part.column(2))
                packs = [x[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(packs, pa.binary())], ["id", "label", "features"])

    found = rows.mapInArrow(run, f"id {rows.schema['__id'].dataType.simpleString()}, label int, features binary").collect()
    found.sort(key=lambda r: (r.id, len(r.features), bytes(r.features)))
    features = [np.frombuffer(r.features, np.float32).reshape(-1, FEATURES) for r in found]
    return learn(features, np.array([min(1, max(0, r.label)) for r in found]))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        for batch in batches:
            for part in wordhash.portions(batch, "text"):
                score = model.score(*passages(part.column(2)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
