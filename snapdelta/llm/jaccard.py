"""Exact join of documents on n-gram Jaccard similarity, as a join in a metric space.

One minus the similarity is a metric, so distances to pivots tell which documents can be linked. Every document of a region
goes to its nearest pivot, the cells being Voronoi regions, and also into the region of each pivot that is at most 2 * radius
further away: by the triangle inequality, documents within the radius of each other then meet in one region at least. Regions
are divided again by pivots of their own until they are small, and compared there; distances to the pivots rule out pairs
there once more. Documents within the radius of a pivot are linked to it at once, and a region whose documents are all joined
needs no further work, so a large group of copies costs a few stars and not all its pairs.

Nearly all documents have no link, and lie at distance one from everything, where pivots tell nothing. They are put aside first, by
an exact filter. Linked sets of at most r shingles differ in at most d = 2 r (1 - t) / (1 + t) of them. All shingles are dealt
into d + 1 + ``SPARE`` parts by a hash; at least one part more than ``SPARE`` is then the same in both. A set has one signature for
each part that is not empty (and for empty ones if there are more than ``SPARE``), so linked sets have a signature in common. Sizes
are divided into ranges that a linked pair spans two of at most, and a set has the signatures of its own range and of the next.
A signature stands for several shingles at once, so it stays rare however often single shingles come again in a large corpus.
Sets without a signature that another has are left out; the first regions are the connected parts of what shares one. Of the rest,
sets with too many shingles that stand in no other set are left out too.

Regions beyond ``LEAF_ROWS`` are never in one task. If pivots do not divide one (its documents are all equally far from each
other), its rows are dealt into blocks, and each two blocks meet in a task: exact, and bounded in memory.

Defined results: equal sets are one class. A text without words has an empty set and is linked with nothing. Rows that share an
id are documents of their own. A row without id is linked like any other; ``component_id`` is the smallest id that is not null
in its component, or null. Ties cannot arise. An empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapdelta.llm import wordhash
from snapdelta.llm.components import components, sharing
from snapdelta.llm.wordhash import shingle_set
from snapdelta.session import settled

WORDS = 4
SIMILARITY = (85, 100)
# Rows and shingles of a region that one task compares.
LEAF_ROWS = 1_024
LEAF_ELEMENTS = 1 << 20
PIVOTS = 8
# Regions of so few rows are compared without pivots.
FEW = 32
# Levels of distributed division; what is still too large goes to blocks.
LEVELS = 6
# Parts beyond those that differences can spoil.
SPARE = 4
_PART, _RANGE, _SIZE = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
# Bits per row of the filter by which texts are chosen before they are moved, and bits at most (16 MB); a full filter only lets more through.
FILTER_BITS = 16
MOST_BITS = 1 << 27
# Distances are in floating point; windows are wider by this.
_SLACK = 1e-9


def _unshared(n: str, similarity: tuple[int, int]) -> Column:
    """How many shingles of a set with n a linked set may lack."""
    least, of = similarity
    return F.col(n) - F.expr(f"({least} * {n} + {of - 1}) div {of}")


def linked(common, n_a, n_b, similarity):
    least, of = similarity
    return of * common >= least * (n_a + n_b - common)


def _contents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _text_sets(batch: pa.RecordBatch, words: int):
    """Parts of a batch with the shingle sets of their texts."""
    for part in wordhash.portions(batch, "text"):
        hashes, before = wordhash.words(*wordhash.texts_of(part.column(part.schema.names.index("text"))))
        yield part, [shingle_set(hashes[before[i] : before[i + 1]], words) for i in range(part.num_rows)]


def size_range(n: int, similarity: tuple[int, int]) -> tuple[int, int]:
    """The number of the range of sizes that n lies in, and the greatest size of it; two linked sets lie in one range or in neighbours."""
    least, of = similarity
    number, last = 0, of // least
    while n > last:
        number, last = number + 1, (last + 1) * of // least
    return number, last


def signatures(own: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    """Of two linked sets, that are not equal, at least one signature is the same."""
    least, of = similarity
    if not len(own):
        return np.zeros(0, np.int64)
    number, last = size_range(len(own), similarity)
    found = []
    for instance, most in ((number, last), (number + 1, (last + 1) * of // least)):
        differences = 2 * most * (of - least) // (of + least)
        if not differences:
            continue  # only equal sets are linked
        parts = differences + 1 + SPARE
        named = np.uint64((instance + 1) * int(_RANGE) % 2**64)
        values = wordhash.mix(own ^ named)
        part = (values % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        full, first, sizes = np.unique(part[order], return_index=True, return_counts=True)
        sums = np.add.reduceat(wordhash.mix(values[order] + _SIZE), first)
        found.append(wordhash.mix(sums + full.astype(np.uint64) * _PART + named + sizes.astype(np.uint64) * _SIZE))
        if parts - len(full) > SPARE:
            empty = np.setdiff1d(np.arange(parts), full)
            found.append(wordhash.mix(empty.astype(np.uint64) * _PART + named))
    return np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)


def signed(rows: DataFrame, words: int, similarity) -> DataFrame:
    """Per row: set size, a 128-bit digest of the set, its first half as ``name``, and the signatures."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part, sets in _text_sets(batch, words):
                found = [signatures(own, similarity) for own in sets]
                names = [hashlib.blake2b(own.tobytes(), digest_size=16).digest() for own in sets]
                ends = pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([len(own) for own in sets], pa.int64()),
                        pa.array(names, pa.binary()),
                        pa.array([int.from_bytes(name[:8], "little", signed=True) for name in names], pa.int64()),
                        pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *found]))),
                    ],
                    ["doc_id", "text_hash", "n_shingles", "digest", "name", "signatures"],
                )

    return rows.mapInArrow(run, f"doc_id {kind}, text_hash bigint, n_shingles bigint, digest binary, name bigint, signatures array<bigint>")


def _promising(rows: DataFrame) -> DataFrame:
    """The names of sets with a signature that another set has. Copies have one name and count as one."""
    posts = rows.select("name", F.explode("signatures").alias("signature"))
    alone = posts.groupBy("signature").agg(F.min("name").alias("name"), F.max("name").alias("other")).where("name = other")
    alone = alone.groupBy("name").agg(F.count(F.lit(1)).alias("alone"))
    sizes = rows.select("name", F.size("signatures").alias("n")).where("n > 0").distinct()
    return sizes.join(alone, "name", "left").where(F.col("n") > F.coalesce("alone", F.lit(0))).select("name").distinct()


def _posts(sets: DataFrame, similarity) -> DataFrame:
    """``node`` and ``signature`` of each set."""

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            at, flat = lists.offsets.to_numpy(), lists.flatten().to_numpy().view(np.uint64)
            found = [signatures(flat[at[i] - at[0] : at[i + 1] - at[0]], similarity) for i in range(batch.num_rows)]
            nodes = np.repeat(batch.column(0).to_numpy(), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.concatenate([np.zeros(0, np.int64), *found]))], ["node", "signature"])

    return sets.select("node", "elements").mapInArrow(run, "node bigint, signature bigint")


def chosen(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose second column, a hash, may be the ``__hash`` of a wanted one: a filter of bounded size, sent to the scan, so that other texts are not moved."""
    bits = min(MOST_BITS, max(64, FILTER_BITS * wanted.count()) // 64 * 64)
    slot = F.pmod("__hash", F.lit(bits))
    words = wanted.select((slot / 64).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(pmod(__hash, {bits}) % 64 as int))").alias("bit"))
    table = words.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    held = np.zeros(bits // 64, np.int64)
    held[table.column("word").to_numpy()] = table.column("bit").to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast(held.view(np.uint64))

    def run(batches):
        known = shared.value
        for batch in batches:
            place = batch.column(1).to_numpy() % bits
            yield batch.filter(pa.array((known[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1))

    return rows.mapInArrow(run, rows.schema)


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """``node``, the set's size and its shingles, from ``node`` and ``text``."""

    def run(batches):
        for batch in batches:
            for part, sets in _text_sets(batch, words):
                ends = pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32))
                flat = pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in sets], pa.int32()), pa.ListArray.from_arrays(ends, flat)], ["node", "n", "elements"])

    return texts.select("node", "text").mapInArrow(run, "node bigint, n int, elements array<bigint>")


def alone(sets: DataFrame, similarity) -> DataFrame:
    """The ``node`` of every set of which too many shingles stand in no other set: it has no link."""
    posts = sets.select("node", F.explode("elements").alias("element"))
    single = posts.groupBy("element").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node")).where("n = 1")
    single = single.groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    return settled(single.join(sets.select("node", "n"), "node").where(F.col("alone") > _unshared("n", similarity)).select("node"), "jaccard-alone")


class Region:
    """Some sets, compared with each other. Sets of one label are known to be joined."""

    def __init__(self, sets: list[np.ndarray], labels: np.ndarray, similarity=SIMILARITY):
        self.similarity, self.radius = similarity, 1 - similarity[0] / similarity[1]
        self.sizes = np.array([len(x) for x in sets], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        self.names, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.mask = np.zeros(len(self.names), bool)
        _, first, self.root = np.unique(labels, return_index=True, return_inverse=True)
        self.root = first[self.root]
        self.compared = 0

    def common(self, row: int, others: np.ndarray) -> np.ndarray:
        """Number of shingles that a row shares with each of some others."""
        self.compared += len(others)
        own = self.flat[self.starts[row] : self.starts[row + 1]]
        self.mask[own] = True
        if 4 * len(others) > len(self.sizes):
            counts = np.add.reduceat(self.mask[self.flat], self.starts[:-1], dtype=np.int64)[others]
        else:
            sizes = self.sizes[others]
            ends = np.cumsum(sizes)
            at = np.arange(ends[-1]) + np.repeat(self.starts[others] - ends + sizes, sizes)
            counts = np.add.reduceat(self.mask[self.flat[at]], ends - sizes, dtype=np.int64)
        self.mask[own] = False
        return counts

    def _join(self, row: int, others: np.ndarray) -> None:
        roots = np.unique(np.append(self.root[others], self.root[row]))
        self.root[np.isin(self.root, roots)] = roots[0]

    def join(self, rows: np.ndarray) -> None:
        """Find the components among some rows."""
        if len(rows) < 2 or (self.root[rows] == self.root[rows[0]]).all():
            return
        if len(rows) <= FEW:
            return self._direct(rows, np.zeros((0, len(rows))))
        pivots = rows[np.unique(np.linspace(0, len(rows) - 1, PIVOTS).astype(np.int64))]
        away = np.empty((len(pivots), len(rows)))
        for k, pivot in enumerate(pivots):
            common = self.common(pivot, rows)
            away[k] = 1 - common / (self.sizes[pivot] + self.sizes[rows] - common)
            self._join(pivot, rows[linked(common, self.sizes[pivot], self.sizes[rows], self.similarity)])
        if (self.root[rows] == self.root[rows[0]]).all():
            return None
        inside = away <= away.min(0) + 2 * self.radius + _SLACK
        parts = [np.flatnonzero(x) for x in inside]
        if sum(map(len, parts)) <= 1.5 * len(rows) and max(map(len, parts)) <= 0.9 * len(rows):
            for part in parts:
                self.join(rows[part])
            return None
        return self._direct(rows, away)

    def _direct(self, rows: np.ndarray, away: np.ndarray) -> None:
        """Each row with the later ones of other components that length and pivots do not rule out."""
        least, of = self.similarity
        sizes = self.sizes[rows]
        # Rows of small components first: a large one is then met by them, and not each of its members by all.
        _, component, members = np.unique(self.root[rows], return_inverse=True, return_counts=True)
        order = np.argsort(members[component], kind="stable")
        rows, sizes, away = rows[order], sizes[order], away[:, order]
        for i, row in enumerate(rows[:-1]):
            later = np.arange(i + 1, len(rows))
            later = later[self.root[rows[later]] != self.root[row]]
            n = sizes[later]
            later = later[of * np.minimum(n, sizes[i]) >= least * np.maximum(n, sizes[i])]
            if len(away) and len(later):
                later = later[(np.abs(away[:, later] - away[:, i : i + 1]) <= self.radius + _SLACK).all(0)]
            if len(later):
                others = rows[later]
                common = self.common(row, others)
                found = others[linked(common, self.sizes[row], self.sizes[others], self.similarity)]
                if len(found):
                    self._join(row, found)


def _leaves(rows: DataFrame, similarity) -> DataFrame:
    """Links ``a``, ``b`` from each row to one of its component, of regions that fit into a task. Columns: region, node, elements, label."""

    def links(nodes, sets, labels):
        region = Region(sets, np.array(labels, np.int64), similarity)
        region.join(np.arange(len(sets)))
        nodes = np.array(nodes, np.int64)
        to = nodes[region.root]
        own = np.flatnonzero(nodes != to)
        return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(to[own])], ["a", "b"])

    def run(batches):
        now, nodes, sets, labels = None, [], [], []
        for batch in batches:
            lists = batch.column(2)
            at, flat = lists.offsets.to_numpy(), lists.flatten().to_numpy()
            for i, (name, node, label) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist())):
                if name != now:
                    if len(nodes) > 1:
                        yield links(nodes, sets, labels)
                    now, nodes, sets, labels = name, [], [], []
                nodes.append(node)
                sets.append(flat[at[i] - at[0] : at[i + 1] - at[0]].view(np.uint64).copy())
                labels.append(label)
        if len(nodes) > 1:
            yield links(nodes, sets, labels)

    ordered = rows.select("region", "node", "elements", "label").repartition("region").sortWithinPartitions("region", "node")
    return ordered.mapInArrow(run, "a bigint, b bigint")


def _parts(leaf_rows: int, times: int = 1):
    """Into how many parts a region's rows are dealt, so that each fits ``times`` over into a leaf."""
    return F.greatest(F.ceil(times * F.col("rows") / leaf_rows), F.ceil(times * F.col("total") / LEAF_ELEMENTS)).cast("int")


def _divided(rows: DataFrame, sizes: DataFrame, level: int, similarity, leaf_rows: int) -> DataFrame:
    """Rows of large regions and their pivots: ``near`` are those within the radius, ``cells`` those whose regions they go to."""
    slot = F.pmod(F.xxhash64("node", F.lit(level)), F.lit(PIVOTS))
    chosen = rows.groupBy("region", slot.alias("slot")).agg(F.min(F.struct(F.xxhash64("node", F.lit(level), F.lit("pivot")).alias("h"), "node", "elements")).alias("pivot"))
    parts = sizes.select("region", _parts(leaf_rows).alias("parts"))
    pivots = chosen.join(parts, "region").withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
    pivots = pivots.select(F.col("region").alias("of_region"), F.col("part").alias("of_part"), "pivot.node", "pivot.elements")
    dealt = rows.join(parts, "region").withColumn("part", F.pmod(F.xxhash64("node", F.lit("part")), "parts").cast("int")).drop("parts")
    radius = 1 - similarity[0] / similarity[1]

    def measured(own: pa.Table, centres: pa.Table) -> pa.Table:
        own = own.select(["region", "node", "n", "elements", "label"])
        if not own.num_rows:
            return own.append_column("near", pa.array([], pa.list_(pa.int64()))).append_column("cells", pa.array([], pa.list_(pa.int64())))
        names = centres.column("node").to_numpy()
        sets = [x.values.to_numpy().view(np.uint64) for side in (centres, own) for x in side.column("elements")]
        region = Region(sets, np.arange(len(sets)), similarity)
        members = np.arange(len(names), len(sets))
        away = np.empty((len(names), len(members)))
        close = np.zeros(away.shape, bool)
        for k in range(len(names)):
            common = region.common(k, members)
            away[k] = 1 - common / (region.sizes[k] + region.sizes[members] - common)
            close[k] = linked(common, region.sizes[k], region.sizes[members], similarity)
        inside = away <= away.min(0) + 2 * radius + _SLACK
        lists = [pa.array([names[x] for x in which.T], pa.list_(pa.int64())) for which in (close, inside)]
        return own.append_column("near", lists[0]).append_column("cells", lists[1])

    schema = "region bigint, node bigint, n int, elements array<bigint>, label bigint, near array<bigint>, cells array<bigint>"
    return dealt.groupBy("region", "part").cogroup(pivots.groupBy("of_region", "of_part")).applyInArrow(measured, schema)


def _sized(rows: DataFrame) -> DataFrame:
    return rows.groupBy("region").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("total"))


def _fits(leaf_rows: int):
    return (F.col("rows") <= leaf_rows) & (F.col("total") <= LEAF_ELEMENTS)


def _in_blocks(rows: DataFrame, sizes: DataFrame, leaf_rows: int) -> DataFrame:
    """Rows of regions that do not divide, once for each two blocks of their region that meet."""
    dealt = rows.join(sizes.select("region", _parts(leaf_rows, 2).alias("parts")), "region")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node", F.lit("block")), "parts").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    meeting = F.xxhash64("region", F.least("own", "other"), F.greatest("own", "other"), F.lit("blocks"))
    return dealt.select(meeting.alias("region"), "node", "n", "elements", "label")


def joined(sets: DataFrame, regions: DataFrame, similarity, leaf_rows: int, known: DataFrame | None = None) -> DataFrame:
    """Links ``a``, ``b`` that join all similar sets: ``sets`` with node, n and elements; ``regions`` with node and component.

    Sets outside of all regions are left out. ``known`` has for each node the ``label`` that it shares with those it is joined
    to already; such pairs are passed over.
    """
    narrow = sets.select("node", "n").join(regions.select("node", F.col("component").alias("region")), "node")
    narrow = narrow.withColumn("label", F.col("node")) if known is None else narrow.join(known, "node")
    sizes = settled(_sized(narrow), "jaccard-sizes")
    # Regions of one set are done. Sets are moved to the others' rows, and are never sent to all tasks, however few they are.
    kept = narrow.join(sizes.where("rows > 1"), "region").select("region", "node", "label", _fits(leaf_rows).alias("fits"))
    rows = settled(sets.hint("merge").join(kept, "node").select("region", "node", "n", "elements", "label", "fits"), "jaccard-regions")
    small, rows = rows.where("fits"), rows.where("NOT fits").drop("fits")
    found = [settled(_leaves(small, similarity), "jaccard-links")]
    large = sizes.where(~_fits(leaf_rows))
    level = 0
    while not large.isEmpty():
        rows = rows.join(large.select("region"), "region", "left_semi")
        divided = settled(_divided(rows, large, level, similarity, leaf_rows), "jaccard-divided")
        stars = settled(divided.select(F.col("node").alias("a"), F.explode("near").alias("b")).where("a <> b"), "jaccard-links")
        labels = divided.select(F.col("node").alias("a"), F.col("label").alias("b")).where("a <> b")
        found.append(stars)
        joined_now = components(divided.select("node").distinct(), stars.unionByName(labels))
        divided = divided.drop("label").join(joined_now.withColumnRenamed("component", "label"), "node")
        divided = settled(divided, "jaccard-divided")
        open_ = divided.groupBy("region").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("rows"), F.sum("n").alias("total"), F.sum(F.size("cells")).alias("after")).where("low <> high")
        open_ = settled(open_, "jaccard-open")
        divides = (F.col("after") <= 1.5 * F.col("rows")) & F.lit(level + 1 < LEVELS)
        kept = divided.join(open_.where(divides).select("region"), "region", "left_semi")
        kept = kept.withColumn("cell", F.explode("cells")).select(F.xxhash64("region", "cell", F.lit(level)).alias("region"), "node", "n", "elements", "label")
        dense = open_.where(~divides).select("region", "rows", "total")
        dense = _in_blocks(divided.select("region", "node", "n", "elements", "label").join(dense.select("region"), "region", "left_semi"), dense, leaf_rows)
        found.append(settled(_leaves(dense, similarity), "jaccard-links"))
        rows = settled(kept, "jaccard-regions")
        sizes = settled(_sized(rows), "jaccard-sizes")
        small = rows.join(sizes.where("rows > 1").where(_fits(leaf_rows)).select("region"), "region", "left_semi")
        found.append(settled(_leaves(small, similarity), "jaccard-links"))
        large = sizes.where(~_fits(leaf_rows))
        level += 1
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links


def clustered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity=SIMILARITY, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row."""
    contents = _contents(docs, id_col, text_col)
    rows = settled(signed(contents, words, similarity), "jaccard-rows")
    found = rows.join(_promising(rows), "name", "left_semi").where("n_shingles > 0")
    first = F.min(F.struct("doc_id", "text_hash")).alias("first")
    classes = found.groupBy("digest").agg(first, F.min("doc_id").alias("least_id"))
    classes = classes.select(F.monotonically_increasing_id().alias("node"), "digest", "least_id", "first.doc_id", "first.text_hash")
    classes = settled(classes, "jaccard-classes")
    wanted = classes.select("node", F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))
    texts = chosen(contents, wanted).hint("merge").join(wanted, same)
    texts = texts.dropDuplicates(["doc_id", "text_hash"])
    sets = settled(_sets(texts, words), "jaccard-sets")
    apart = alone(sets, similarity)
    nodes = settled(sets.select("node").join(apart, "node", "left_anti"), "jaccard-nodes")
    posts = settled(_posts(sets, similarity).join(nodes, "node", "left_semi"), "jaccard-posts")
    links = joined(sets, sharing(posts, ["signature"]), similarity, leaf_rows)
    found = components(nodes, links)
    named = classes.select("node", "digest", "least_id").join(found, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of_digest = named.join(least, "component").select("digest", F.struct("component_id").alias("of"))
    # Sets that were put aside have the copies of their own texts as their component.
    others = rows.where("n_shingles > 0").join(classes.select("digest"), "digest", "left_anti")
    others = others.groupBy("digest").agg(F.min("doc_id").alias("component_id")).select("digest", F.struct("component_id").alias("of"))
    out = rows.select("doc_id", "n_shingles", "digest").join(of_digest.unionByName(others), "digest", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("of.component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"))
