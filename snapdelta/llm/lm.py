"""Scoring texts with the formula of a weighted bigram backoff automaton learnt from the corpus.

States are contexts of one word, the sentence start among them, and the root below them. A state has an arc for every word
seen after its context, and one failure arc to the root, which has an arc for every word seen at all and one for any other
word. Probabilities are smoothed with ``KAPPA`` pseudo-counts of the root's: after context v, word w has
(c(v w) + KAPPA p(w)) / (c(v) + KAPPA); the failure arc weighs KAPPA / (c(v) + KAPPA). At the root a known word has
(1 - UNKNOWN) c(w) / N and any other UNKNOWN, so every state's probabilities add up to one. No automaton is
walked: a word's state is the word before it, so the weights of all tokens are computed at once from two sorted arrays. Tokens are words with A-Z lowered,
then one end.

Nothing is counted in one place. Texts are dealt into blocks of bounded size; a block asks for its distinct n-grams, the
requests are packed by n-gram hash, counted, and answered, and each block builds the part of the automaton that its texts
can reach. A frequent word is one entry per block, however often it occurs. N-grams found in one block only need no answer.

Defined results: a null or empty text has the end as its only token; null ids count as the empty text for the choice of
training texts, whose crc32 is 0. Repeated rows are repeated training texts and get equal scores. With no training texts all counts
are 0: scores use the root's unknown word, and 0 training tokens are reported. Extra columns are left out. An empty table gives
an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapdelta.llm import wordhash
from snapdelta.llm.common import pieces, text_bytes
from snapdelta.session import settled

KAPPA = 40.0
UNKNOWN = 0.05
BLOCK_BYTES = 12 << 20
BUCKET_BYTES = 24 << 20
END = np.uint64(0xE0D0F7E87A11CE55)
START = np.uint64(0x57A27B0F7E87ACE5)
_PAIR = np.uint64(0x9E3779B97F4A7C15)
# Arcs are known by the upper 56 bits of their hash; words by all 64.
_NARROW = 7


def held_out(key: Column, parts: int = 7, part: int = 2) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(parts)) == part


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, texts end to end, and where each text begins, with the total last."""
    hashes, before = wordhash.words(*wordhash.texts_of(column))
    texts = len(column)
    out = np.empty(len(hashes) + texts, np.uint64)
    starts = before + np.arange(texts + 1)
    ends = starts[1:] - 1
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner] = hashes
    out[ends] = END
    return out, starts


def contexts_of(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The token before each token, the start before a text's first."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[starts[:-1]] = START
    return before


def arcs_of(contexts: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return wordhash.mix(contexts * _PAIR + tokens)


def _counted(keys: np.ndarray, training: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with how many of them are in training texts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    if not len(first):
        return keys, np.zeros(0, np.uint32)
    return keys[first], np.add.reduceat(training[order].astype(np.uint32), first).astype(np.uint32)


def _packed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _upper(keys: np.ndarray, width: int) -> np.ndarray:
    return keys >> np.uint64(64 - 8 * width)


def _narrow(keys: np.ndarray, width: int) -> bytes:
    """The upper bytes of sorted keys, byte by byte: the first ones hardly change, so they shrink to nothing."""
    return _packed(np.ascontiguousarray(np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, 8 - width :].T).tobytes())


def _wide(data: bytes, width: int) -> np.ndarray:
    """``_upper`` of the keys that were packed."""
    got = np.frombuffer(_unpacked(data), np.uint8).reshape(width, -1)
    out = np.zeros((got.shape[1], 8), np.uint8)
    out[:, :width] = got.T
    return out.view(np.uint64).ravel()


def _buckets(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's keys begin; keys are sorted, and a bucket is a range of their upper bits."""
    bounds = (np.arange(1, buckets, dtype=object) * (1 << 64) // buckets).astype(np.uint64) if buckets > 1 else np.zeros(0, np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, bounds), [len(keys)]))


WORD, ARC, STAT = 0, 1, 2
_REQUEST = "bucket int, block int, kind int, keys binary, counts binary"
_REPLY = "block int, kind int, keys binary, counts binary"


def _requests(table: pa.Table, buckets: int) -> pa.Table:
    """A block's distinct words and arcs with their counts in its training texts, packed by bucket."""
    block = table.column("block")[0].as_py()
    texts = table.column("text").combine_chunks()
    tokens, starts = tokens_of(texts)
    training = np.repeat(~np.asarray(table.column("held_out").to_numpy(zero_copy_only=False), bool), np.diff(starts))
    contexts = contexts_of(tokens, starts)
    rows: dict[str, list] = {name: [] for name in ("bucket", "block", "kind", "keys", "counts")}
    for kind, keys, width in ((WORD, tokens, 8), (ARC, arcs_of(contexts, tokens), _NARROW)):
        keys, counts = _counted(keys, training)
        at = _buckets(keys, buckets)
        for bucket in range(buckets):
            first, last = at[bucket], at[bucket + 1]
            if first < last:
                rows["bucket"].append(bucket)
                rows["block"].append(block)
                rows["kind"].append(kind)
                rows["keys"].append(_narrow(keys[first:last], width))
                rows["counts"].append(_packed(counts[first:last].tobytes()))
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    return pa.table([pa.array(rows[n], k) for n, k in zip(rows, kinds)], list(rows))


def _answers(table: pa.Table) -> pa.Table:
    """Per block and kind, the keys that training texts of other blocks hold, with their counts there; and totals of words."""
    out: dict[str, list] = {name: [] for name in ("block", "kind", "keys", "counts")}
    kinds = table.column("kind").to_numpy()
    for kind, width in ((WORD, 8), (ARC, _NARROW)):
        part = table.filter(pa.array(kinds == kind))
        if not part.num_rows:
            continue
        packs = [_wide(x.as_py(), width) for x in part.column("keys")]
        counts = np.concatenate([np.frombuffer(_unpacked(x.as_py()), np.uint32) for x in part.column("counts")])
        keys = np.concatenate(packs)
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
        totals = np.add.reduceat(counts[order].astype(np.int64), np.flatnonzero(new))
        others = np.empty(len(keys), np.int64)
        others[order] = totals[np.cumsum(new) - 1]
        others -= counts
        if kind == WORD:
            out["block"].append(-1)
            out["kind"].append(STAT)
            out["keys"].append(b"")
            out["counts"].append(np.array([(totals > 0).sum(), totals.sum()], np.int64).tobytes())
        at = 0
        for pack, block in zip(packs, part.column("block").to_pylist()):
            own = others[at : at + len(pack)]
            at += len(pack)
            known = own > 0
            if known.any():
                out["block"].append(block)
                out["kind"].append(kind)
                out["keys"].append(_narrow(pack[known] << np.uint64(64 - 8 * width), width))
                out["counts"].append(_packed(own[known].astype(np.int64).tobytes()))
    types = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    return pa.table([pa.array(out[n], k) for n, k in zip(out, types)], list(out))


class Automaton:
    """Counts of the words and pairs that a block's texts can reach."""

    def __init__(self, words, word_counts, arcs, arc_counts, starts: int, total: int, kappa=KAPPA, unknown=UNKNOWN):
        self.words, self.word_counts, self.arcs, self.arc_counts = words, word_counts, arcs, arc_counts
        self.starts, self.total, self.kappa, self.unknown = starts, max(total, 1), kappa, unknown

    @staticmethod
    def _find(keys, counts, wanted):
        if not len(keys):
            return np.zeros(len(wanted), np.int64)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, counts[at], 0)

    def counts(self, tokens: np.ndarray) -> np.ndarray:
        return self._find(self.words, self.word_counts, tokens)

    def weights(self, tokens: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per token its count, and log10 of the weight of the arcs taken: its own, or the failure arc and the root's."""
        counts = self.counts(tokens)
        contexts = contexts_of(tokens, starts)
        of_state = np.empty_like(counts)
        of_state[1:] = counts[:-1]
        of_state[starts[:-1]] = self.starts
        taken = self._find(self.arcs, self.arc_counts, arcs_of(contexts, tokens))
        root = np.where(counts > 0, (1 - self.unknown) * counts / self.total, self.unknown)
        return counts, np.log10((taken + self.kappa * root) / (of_state + self.kappa))


def _scores(block_key, texts: pa.Table, replies: pa.Table, documents: int, total: int) -> pa.Table:
    """Results of a block's texts; for the block of totals, one row per pack."""
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_part", "score", "words", "train_tokens"]
    kinds = replies.column("kind").to_numpy() if replies.num_rows else np.zeros(0, np.int32)
    if not texts.num_rows:
        found = [np.frombuffer(replies.column("counts")[int(i)].as_py(), np.int64) for i in np.flatnonzero(kinds == STAT)]
        words, tokens = (sum(int(x[k]) for x in found) for k in (0, 1))
        empty = [pa.nulls(1, texts.schema.field("doc_id").type), pa.array([None], pa.bool_())]
        return pa.table([*empty, *[pa.array([None], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())], pa.array([words], pa.int64()), pa.array([tokens], pa.int64())], names)
    column = texts.column("text").combine_chunks()
    tokens, starts = tokens_of(column)
    training = np.repeat(~np.asarray(texts.column("held_out").to_numpy(zero_copy_only=False), bool), np.diff(starts))
    learnt = []
    for kind, keys, width in ((WORD, tokens, 8), (ARC, arcs_of(contexts_of(tokens, starts), tokens), _NARROW)):
        keys, counts = _counted(keys, training)
        counts = counts.astype(np.int64)
        ranked = _upper(keys, width)
        for i in np.flatnonzero(kinds == kind):
            asked = _wide(replies.column("keys")[int(i)].as_py(), width)
            counts[np.searchsorted(ranked, asked)] += np.frombuffer(_unpacked(replies.column("counts")[int(i)].as_py()), np.int64)
        learnt += [keys, counts]
    counts, weights = Automaton(*learnt, documents, total).weights(tokens, starts)
    first = starts[:-1]
    return pa.table(
        [
            texts.column("doc_id"),
            texts.column("held_out"),
            pa.array(np.diff(starts), pa.int64()),
            pa.array(np.add.reduceat((counts > 0).astype(np.int64), first), pa.int64()),
            pa.array(np.add.reduceat(np.log10(counts + 1.0), first), pa.float64()),
            pa.array(np.add.reduceat(weights, first), pa.float64()),
            pa.nulls(texts.num_rows, pa.int64()),
            pa.nulls(texts.num_rows, pa.int64()),
        ],
        names,
    )


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    documents, total = _training(rows)
    size = text_bytes(rows)
    blocks, buckets = pieces(size, BLOCK_BYTES), pieces(size, BUCKET_BYTES)
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    # Both uses of the dealt texts have one plan, so Spark writes this shuffle once.
    dealt = rows.withColumn("block", block).repartition(max(2, blocks), "block")
    requests = dealt.groupBy("block").applyInArrow(lambda t: _requests(t, buckets), _REQUEST)
    # Small packs would be put into few tasks by their bytes; counting them is the work, so each bucket has its own.
    replies = requests.repartition(max(2, buckets), "bucket").groupBy("bucket").applyInArrow(_answers, _REPLY)
    result = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_part double, score double, words bigint, train_tokens bigint"
    out = dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(
        lambda key, texts, answers: _scores(key, texts, answers, documents, total), result
    )
    out = settled(out, "lm-scores")
    stats = out.where("words IS NOT NULL").agg(
        F.coalesce(F.sum("words"), F.lit(0)).alias("words"), F.coalesce(F.sum("train_tokens"), F.lit(0)).alias("train_tokens")
    )
    texts = out.where("words IS NULL").drop("words", "train_tokens").crossJoin(F.broadcast(stats))  # one row
    all_mass = F.log10((F.col("train_tokens") + F.col("words") + 1).cast("double"))
    return texts.select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", (F.col("base_part") - F.col("n_tokens") * all_mass).alias("base_score"), "score"
    )


def _training(rows: DataFrame) -> tuple[int, int]:
    """Number of training texts and of their tokens, counted per task and added up."""

    def run(batches):
        texts, tokens = 0, 0
        for batch in batches:
            for part in wordhash.portions(batch, "text"):
                _, starts = tokens_of(part.column(0))
                texts += part.num_rows
                tokens += int(starts[-1])
        yield pa.RecordBatch.from_arrays([pa.array([texts], pa.int64()), pa.array([tokens], pa.int64())], ["texts", "tokens"])

    counted = rows.where("NOT held_out").select("text").mapInArrow(run, "texts bigint, tokens bigint")
    found = counted.agg(F.sum("texts"), F.sum("tokens")).first()
    return int(found[0] or 0), int(found[1] or 0)
