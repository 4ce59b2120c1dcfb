"""Near-duplicate documents: fast similarity sketches, banding, and exact verification on full shingle sets.

A document's set holds the hashes of its distinct four-word shingles (the whole sequence when it has fewer words). The sketch
has ``COORDINATES`` bins. In round r every element is placed into one hashed bin with a value that ranks after all earlier
rounds; each bin keeps its least value, and rounds end once every bin is full. After ``COORDINATES`` random rounds, round r
fills bin r - COORDINATES from all elements, so no bin stays empty however small the set. Equal bins of two sketches estimate
the similarity, with the concentration of independent samples.

Equal sets are one class before anything is compared. Classes that share a band become candidates; each link between classes
is confirmed on the full sets. Within a bucket classes are compared with one centre first and joined into components;
afterwards only members of different components are left to compare, so a group of thousands of copies costs a star and not
all its pairs. What is left is compared on full sets without any pair as a row: sets with too many shingles of their own are put
aside first, which is exact, and the others meet in regions of bounded size (``jaccard.joined``), where pairs that are
joined already are passed over. So a pair at the threshold is missed only if it shares no band: (1 - 0.8^4)^32, or 5 x 10^-8.

Defined results: a text without words has an empty set and is linked with nothing. A row without id can be named by nobody; it
forms a component of its own with a null ``component_id`` and is kept. Rows with one id are one document, which links if either
text does. Repeated rows give repeated results; ties cannot arise, as a component is named by its smallest id. An empty table
gives an empty result. Extra columns are carried by ``kept_rows`` and left out otherwise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapdelta.llm import jaccard, wordhash
from snapdelta.llm.components import components, sharing
from snapdelta.llm.wordhash import shingle_set
from snapdelta.session import settled

WORDS = 4
COORDINATES = 128
ROWS = 4
SIMILARITY = (80, 100)
# A pair with a centre is looked at early if its sketches agree in so many bins; what this passes over is looked at later.
LEAST_EQUAL = 80

_random = np.random.default_rng(7_001)
_FACTORS = wordhash.factors(_random)
_ROUND_SEEDS = _random.integers(1, 2**63, 2 * COORDINATES, dtype=np.uint64)
_FULL = np.uint64(2**64 - 1)


def sketch(elements: np.ndarray) -> np.ndarray:
    """The least (round, value) of every bin, as one number each."""
    bins = np.full(COORDINATES, _FULL, np.uint64)
    at_once = max(1, min(COORDINATES, 800 // len(elements)))
    done = 0
    while done < 2 * COORDINATES:
        rounds = np.arange(done, min(done + at_once, COORDINATES if done < COORDINATES else 2 * COORDINATES))
        values = wordhash.mix(elements[None, :] ^ _ROUND_SEEDS[rounds][:, None])
        placed = (values & np.uint64(COORDINATES - 1)).astype(np.int64) if done < COORDINATES else np.repeat(rounds[:, None] - COORDINATES, len(elements), 1)
        ranked = (values >> np.uint64(8)) | (rounds.astype(np.uint64)[:, None] << np.uint64(56))
        np.minimum.at(bins, placed.ravel(), ranked.ravel())
        done = int(rounds[-1]) + 1
        if (bins != _FULL).all():
            break
    return bins


def bands_of(bins: np.ndarray) -> np.ndarray:
    rows = wordhash.mix(bins).reshape(-1, ROWS)
    mixed = np.arange(len(rows), dtype=np.uint64)
    for k in range(ROWS):
        mixed += rows[:, k] * _FACTORS[k]
    return wordhash.mix(mixed)


def sketched(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """Per row: set size, a 128-bit digest of the set, band hashes and one byte of every bin."""
    import hashlib

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    empty = np.zeros(0, np.int64)

    def run(batches):
        for batch in batches:
            for part in wordhash.portions(batch, "text"):
                hashes, before = wordhash.words(*wordhash.texts_of(part.column(1)))
                sizes, names, bands, marks = [], [], [], []
                for i in range(part.num_rows):
                    own = shingle_set(hashes[before[i] : before[i + 1]], words)
                    sizes.append(len(own))
                    names.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    bins = sketch(own) if len(own) else None
                    bands.append(bands_of(bins).view(np.int64) if len(own) else empty)
                    mark = (wordhash.mix(bins) & np.uint64(255)).astype(np.uint8) if len(own) else np.zeros(0, np.uint8)
                    marks.append(mark.tobytes())
                ends = np.cumsum([0, *map(len, bands)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(sizes, pa.int64()),
                        pa.array(names, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([empty, *bands]))),
                        pa.array(marks, pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "digest", "bands", "marks"],
                )

    return rows.mapInArrow(run, f"doc_id {kind}, n_shingles bigint, digest binary, bands array<bigint>, marks binary")


def _texts_of(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``node`` and ``text`` of the rows with an id among ``nodes``. Most others are left out where they are read, so texts of documents
    without a candidate are not moved; the join then says which of the rest belong, in the same way however few nodes there are.
    """
    texts = docs.select(F.col(id_col).alias("node"), F.xxhash64(id_col).alias("hash"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chosen = jaccard.chosen(texts, nodes.select("node", F.xxhash64("node").alias("__hash")))
    return chosen.hint("merge").join(nodes, "node", "left_semi").select("node", "text")


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """``node`` and its shingle set as bytes, from ``node`` and ``text``."""
    kind = texts.schema["node"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in wordhash.portions(batch, "text"):
                hashes, before = wordhash.words(*wordhash.texts_of(part.column(1)))
                sets = [shingle_set(hashes[before[i] : before[i + 1]], words).tobytes() for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["node", "elements"])

    return texts.select("node", "text").mapInArrow(run, f"node {kind}, elements binary")


def _promising(pairs: DataFrame) -> DataFrame:
    """Pairs whose sketches agree in enough bins."""
    schema = pairs.schema

    def run(batches):
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, COORDINATES) for c in ("marks_a", "marks_b"))
            yield batch.filter(pa.array((left == right).sum(1) >= LEAST_EQUAL))

    return pairs.mapInArrow(run, schema).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    kind = pairs.schema["a"].dataType.simpleString()
    least, of = similarity
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("elements").alias("of_a")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("elements").alias("of_b")), "b").select("a", "b", "of_a", "of_b")

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                keep = []
                for x, y in zip(part.column(2), part.column(3)):
                    x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                    if of * min(len(x), len(y)) < least * max(len(x), len(y)):
                        keep.append(False)
                        continue
                    merged = np.concatenate((x, y))
                    merged.sort(kind="stable")
                    common = int((merged[1:] == merged[:-1]).sum())
                    keep.append(of * common >= least * (len(x) + len(y) - common) and len(x) > 0)
                yield part.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return both.mapInArrow(run, f"a {kind}, b {kind}")


def _across(members: DataFrame, labels: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Links ``a``, ``b`` that join whatever is similar among members of one bucket in different components."""
    state = members.select("band", "value", "node").join(labels, "node")
    open_ = state.groupBy("band", "value").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    rest = settled(state.join(open_.select("band", "value"), ["band", "value"]), "near-rest")
    numbers = settled(rest.select("node", "component").distinct().withColumn("number", F.monotonically_increasing_id()), "near-numbers")
    shingles = sets.join(numbers, "node").select(F.col("number").alias("node"), "elements")

    def listed(batches):
        for batch in batches:
            data, at = wordhash.texts_of(batch.column(1))
            ends = (at // 8).astype(np.int32)
            flat = pa.array(np.frombuffer(data.tobytes(), np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends), flat)], ["node", "n", "elements"])

    whole = settled(shingles.mapInArrow(listed, "node bigint, n int, elements array<bigint>"), "near-left")
    left = settled(whole.select("node").join(jaccard.alone(whole, similarity), "node", "left_anti"), "near-nodes")
    # Regions are connected parts of the graph of components, so a large component is one node of it.
    labels = numbers.groupBy("component").agg(F.min("number").alias("label"))
    known = settled(numbers.join(labels, "component").select(F.col("number").alias("node"), "label"), "near-known")
    named = rest.select("band", "value", "node").join(numbers.select("node", "number"), "node")
    named = named.select("band", "value", F.col("number").alias("node")).join(left, "node", "left_semi").join(known, "node")
    parts = sharing(named.select("band", "value", F.col("label").alias("node")).distinct(), ["band", "value"])
    regions = left.join(known, "node").join(parts.select(F.col("node").alias("label"), "component"), "label").select("node", "component")
    found = settled(jaccard.joined(whole, regions, similarity, jaccard.LEAF_ROWS, known), "near-links")
    ends = [numbers.select(F.col("number").alias(side), F.col("node").alias(f"of_{side}")) for side in "ab"]
    return found.join(ends[0], "a").join(ends[1], "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))


def clustered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity=SIMILARITY) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of every row."""
    rows = settled(sketched(docs, id_col, text_col, words), "near-sketches")
    named = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = named.groupBy("digest").agg(
        F.min("doc_id").alias("node"), F.any_value("bands").alias("bands"), F.any_value("marks").alias("marks")
    )
    classes = settled(classes, "near-classes")
    hits = classes.select("node", F.posexplode("bands").alias("band", "value"))
    sizes = hits.groupBy("band", "value").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = settled(hits.join(sizes, ["band", "value"]), "near-members")
    # Written once: each time that they are found from the members anew costs a shuffle of those.
    marks = settled(classes.select("node", "marks").join(members, "node", "left_semi"), "near-marks")
    candidates = marks.select("node")
    sets = settled(_sets(_texts_of(docs, candidates, id_col, text_col), words), "near-sets")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """Distinct pairs, written once as links."""
        pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        with_marks = pairs.join(marks.select(F.col("node").alias("a"), F.col("marks").alias("marks_a")), "a")
        with_marks = with_marks.join(marks.select(F.col("node").alias("b"), F.col("marks").alias("marks_b")), "b")
        return settled(_verified(_promising(with_marks.select("a", "b", "marks_a", "marks_b")), sets, similarity), name)

    # Centre of a bucket: the member that shares most buckets with most others. What else it holds is left to the regions.
    weight = members.groupBy("node").agg(F.sum("size").alias("weight"))
    weighed = members.select("band", "value", "node").join(weight, "node")
    centres = weighed.groupBy("band", "value").agg(F.max(F.struct("weight", "node")).alias("best"))
    pairs = weighed.select("band", "value", F.col("node").alias("b")).join(centres.select("band", "value", F.col("best.node").alias("a")), ["band", "value"])
    labels = components(candidates, confirmed(pairs.select("a", "b"), "near-links"))
    more = _across(members, labels, sets, similarity)
    labels = components(candidates, more.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    found = classes.select("digest", "node").join(labels, "node", "left")
    found = found.select("digest", F.coalesce("component", "node").alias("component"))
    own = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    out = rows.select("doc_id", "n_shingles", "digest").join(found, "digest", "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), own))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity=SIMILARITY) -> DataFrame:
    """The rows that stay, with all their columns: one document of each component, and rows without an id."""
    found = clustered(docs, id_col, text_col, words, similarity)
    gone = found.where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")
