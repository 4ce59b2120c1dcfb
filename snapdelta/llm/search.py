"""Ranked lexical search by inner products, over posting lists that are blocked by the likeness of their documents.

A document is a vector with one coordinate per term: how much an occurrence count of that term adds for a document of that
length. A query weighs the coordinates; the score is their inner product, in whole numbers. Terms that no query holds add
nothing to any score and are no coordinates.

Documents come in shards of bounded size, wherever the table's own partitions put them, so a term that is in all documents is
no hot key. In a shard, documents lie in the cells of pivot documents (nearest by cosine). Each term has a posting list, cut
into blocks of documents of one cell, and each block stores the coordinatewise maximum of its documents' vectors: the inner
product of a query with that summary bounds the score of every document in the block from above. A query reads its terms'
lists from the one that can add most, and stops when all lists that are left cannot lift a document that is in no earlier list
to its current k-th score. A block is skipped only when its bound is below that score; everything else is scored. So
the ranking is exact. The k best of each task meet in one window per query.

Queries are taken in blocks of bounded size, each with its own coordinates; the driver holds one block's texts and weights.
Terms are known by 64 bits of a hash.

Defined results: a null or empty text, or one without a term, is no document in the counts and has no score. Documents with a
score of 0 are not returned, so a query without terms, or with a null text, has no rows. Ties go to the smaller id, a null id
last. Rows that share an id are documents of their own. A query that repeats with its id counts once; two texts under one query
id are ranked each for itself. Empty tables, of documents or queries, give an empty result. Extra columns are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from snapdelta.llm import wordhash
from snapdelta.llm.common import pieces
from snapdelta.session import settled

K = 10
# Queries, and bytes of their texts, that are searched together (on average; they are dealt by a hash).
QUERIES_AT_ONCE = 256
QUERY_BYTES = 1 << 20
# Documents of one shard, and of one block at most.
SHARD = 1_024
BLOCK = 32
# Cells of a matrix of documents and coordinates that a shard may have, whatever the vocabulary.
CELLS = 1 << 23

_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_SPACED = np.where(_TERM, np.arange(256), 32).astype(np.uint8)


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every term of some texts, A-Z lowered, and the number of terms before each text, with the total last."""
    data, at = wordhash.texts_of(column)
    return wordhash.words(_SPACED[data], at)


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def vectors(docs: DataFrame, vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, number of terms ``n``, and the numbers (``ids``) and occurrences (``tfs``) of the vocabulary's terms, of rows with a term."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text IS NOT NULL")

    def run(batches):
        known = vocabulary.value
        for batch in batches:
            for part in wordhash.portions(batch, "text"):
                hashes, before = terms(part.column(1))
                place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hits = np.flatnonzero(known[place] == hashes)
                keys, tfs = np.unique((np.searchsorted(before, hits, "right") - 1) * len(known) + place[hits], return_counts=True)
                ends = pa.array(np.searchsorted(keys, np.arange(part.num_rows + 1) * len(known)).astype(np.int32))
                n = np.diff(before)
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (keys % len(known), tfs)]
                whole = pa.RecordBatch.from_arrays([part.column(0), pa.array(n), *lists], ["doc_id", "n", "ids", "tfs"])
                yield whole.filter(pa.array(n > 0))

    return rows.mapInArrow(run, f"doc_id {kind}, n bigint, ids array<int>, tfs array<int>")


class Best:
    """The k best documents of one query so far."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    @property
    def least(self) -> int:
        """The score that a further document must reach to count."""
        return self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, scores, doc_ids) -> None:
        self.rows += [(s, d) for s, d in zip(scores, doc_ids) if s >= self.least]
        self.rows.sort(key=lambda row: (-row[0], row[1] is None, 0 if row[1] is None else row[1]))
        del self.rows[self.k :]


class Shard:
    """Some documents as vectors, with a blocked posting list for every term that a query asks for."""

    def __init__(self, doc_ids: list, at: np.ndarray, terms: np.ndarray, adds: np.ndarray, weights: np.ndarray):
        vectors = np.zeros((len(doc_ids), len(weights)), np.int32)
        rows = np.repeat(np.arange(len(doc_ids)), np.diff(at))
        vectors[rows, terms] = adds
        cells = self._cells(vectors, weights)
        order = np.argsort(cells, kind="stable")
        self.cells, self.vectors = cells[order], vectors[order]
        self.doc_ids = [doc_ids[i] for i in order]
        self.most = self.vectors.max(0).astype(np.int64)
        self._lists = {}
        self.scored = 0

    @staticmethod
    def _cells(vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For each document the pivot that is nearest by cosine; pivots are spread evenly over the shard."""
        length = vectors * weights.astype(np.float32)
        length /= np.maximum(np.sqrt(np.einsum("ij,ij->i", length, length)), 1e-9)[:, None]
        n = len(vectors)
        pivots = np.unique(np.linspace(0, n - 1, max(1, math.isqrt(n))).astype(np.int64))
        return np.argmax(length @ length[pivots].T, 1)

    def blocks(self, term: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A term's documents, where its blocks begin, and their summaries."""
        if term not in self._lists:
            docs = np.flatnonzero(self.vectors[:, term])
            cells = self.cells[docs]
            starts = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
            sizes = np.diff(np.append(starts, len(docs)))
            parts = -(-sizes // BLOCK)
            starts = np.repeat(starts, parts) + BLOCK * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
            self._lists[term] = docs, np.append(starts, len(docs)), np.maximum.reduceat(self.vectors[docs], starts, axis=0)
        return self._lists[term]

    def search(self, terms: np.ndarray, weights: np.ndarray, best: Best) -> None:
        """Bring a query's best documents up to date with this shard."""
        can_add = weights * self.most[terms]
        order = np.argsort(-can_add, kind="stable")
        order = order[can_add[order] > 0]
        left = np.cumsum(can_add[order][::-1])[::-1]
        done = np.zeros(len(self.doc_ids), bool)
        for term, rest in zip(terms[order], left):
            if rest < best.least:
                break
            docs, starts, summaries = self.blocks(int(term))
            bounds = summaries[:, terms].astype(np.int64) @ weights
            ranked = np.argsort(-bounds, kind="stable")
            first = 0
            while first < len(ranked) and bounds[ranked[first]] >= best.least:
                # The most promising blocks first, then twice as many each time.
                chosen = ranked[first : 2 * first + 2]
                chosen = chosen[bounds[chosen] >= best.least]
                first = 2 * first + 2
                rows = np.concatenate([docs[starts[b] : starts[b + 1]] for b in chosen])
                rows = rows[~done[rows]]
                done[rows] = True
                self.scored += len(rows)
                scores = self.vectors[rows][:, terms].astype(np.int64) @ weights
                good = np.flatnonzero(scores >= best.least)
                best.add(scores[good].tolist(), [self.doc_ids[i] for i in rows[good]])


def best_of_tasks(rows: DataFrame, context, k: int) -> DataFrame:
    """``query``, ``doc_id`` and ``score`` of the k best documents of each task, from ``vectors``."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    id_type = to_arrow_type(rows.schema["doc_id"].dataType)

    def run(batches):
        queries, weights, n_docs, n_terms = context.value
        best = [Best(k) for _ in queries]
        size = max(1, min(SHARD, CELLS // max(1, len(weights))))
        for batch in batches:
            for first in range(0, batch.num_rows, size):
                part = batch.slice(first, size)
                at = part.column(2).offsets.to_numpy().astype(np.int64)
                ids, tfs = part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy().astype(np.int64)
                lengths = 25 + 75 * part.column(1).to_numpy() * n_docs // n_terms
                adds = 10**9 * tfs // (1000 * tfs + 8 * np.repeat(lengths, np.diff(at)))
                shard = Shard(part.column(0).to_pylist(), at - at[0], ids, adds, weights)
                for (own, times), found in zip(queries, best):
                    shard.search(own, times * weights[own], found)
        found = [(q, d, s) for q, own in enumerate(best) for s, d in own.rows]
        columns = list(zip(*found)) or [[], [], []]
        arrays = [pa.array(values, of) for values, of in zip(columns, (pa.int32(), id_type, pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, ["query", "doc_id", "score"])

    return rows.mapInArrow(run, f"query int, doc_id {kind}, score bigint")


def ranked(
    docs: DataFrame, queries: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text",
    at_once: int = QUERIES_AT_ONCE,
) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id`` and ``score`` of each query's k best documents."""
    spark = docs.sparkSession
    asked = queries.select(F.col(query_id).alias("item_id"), F.coalesce(F.col(query_text), F.lit("")).alias("text")).distinct()
    size = asked.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    blocks = max(pieces(size[0], at_once), pieces(int(size[1] or 0), QUERY_BYTES))
    asked = settled(asked.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int")), "search-queries")
    item = asked.schema["item_id"].dataType.simpleString()
    schema = f"item_id {item}, rank int, doc_id {docs.schema[id_col].dataType.simpleString()}, score bigint"
    results = []
    for block in range(blocks):
        table = asked.where(F.col("block") == block).select("item_id", "text").toArrow().combine_chunks()
        if table.num_rows:
            results.append(_searched(docs, table, k, id_col, text_col))
    if not results:
        return spark.createDataFrame([], schema)
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out


def _searched(docs: DataFrame, table: pa.Table, k: int, id_col: str, text_col: str) -> DataFrame:
    """The ranking of one block of queries."""
    spark, context = docs.sparkSession, docs.sparkSession.sparkContext
    hashes, before = terms(table.column("text").combine_chunks())
    known = np.unique(hashes)
    if not len(known):
        known = np.zeros(1, np.uint64)
    rows = settled(vectors(docs, context.broadcast(known), id_col, text_col), "search-vectors")
    n_docs, n_terms = rows.agg(F.count(F.lit(1)), F.sum("n")).first()
    holding = np.zeros(len(known), np.int64)
    for term, n in rows.select(F.explode("ids").alias("term")).groupBy("term").count().collect():
        holding[term] = n
    weights = np.array([weight(n_docs, int(n)) for n in holding], np.int64)
    wanted = [np.unique(np.searchsorted(known, hashes[a:b]), return_counts=True) for a, b in zip(before, before[1:])]
    found = best_of_tasks(rows, context.broadcast((wanted, weights, n_docs, int(n_terms or 1))), k)
    items = pa.table([pa.array(range(table.num_rows), pa.int32()), table.column("item_id")], ["query", "item_id"])
    best_first = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = found.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
    return top.join(F.broadcast(spark.createDataFrame(items)), "query").select("item_id", "rank", "doc_id", "score")
