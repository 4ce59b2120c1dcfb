"""Byte-level BPE encoding and decoding by a public rank file.

A text is cut into overlapping chunks. Each chunk is pre-tokenised and its pieces are encoded on their own, so one very long
text uses many tasks. A cut found near a chunk's end may be wrong, since the pattern could have read on; two neighbours are
stitched at the first cut that both have, because from a common cut on the pattern sees the same characters. If the overlap
has no common cut (one piece longer than the overlap), the text from the last sure cut on is cut again with the next chunk.
Decoding concatenates the bytes of the ids.

A text of up to ``chunk`` characters is one chunk and needs no shuffle. The rank table is read once on the driver and sent
along; its size is that of the vocabulary file, whatever the data.

Defined results: null and empty texts have no ids; special tokens do not exist, so their names are ordinary text. Every row is
encoded by itself: repeated ids and rows give repeated results; extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapdelta.llm.wordhash import portions

CHUNK = 32_768
OVERLAP = 512
REMEMBERED = 120_000
# Ids that are decoded at once, and bytes of text that are encoded at once, more only for one longer text.
AT_ONCE = 1 << 18
TEXT_BYTES = 1 << 19


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


_NONE = 1 << 30
# Pieces up to so many bytes are merged side by side; longer ones, which are few, one by one.
_SIDE_BY_SIDE = 32


class Merges:
    """Ranks as tables: the id of each byte, and of each pair of ids that makes a token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[key] for key in self.keys.tolist()], np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.made[at], _NONE)

    def ids_of(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, four bytes each: the adjacent pair of lowest rank is joined first, the leftmost of equals."""
        out: list[bytes | None] = [None] * len(pieces)
        groups: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = array("i", (whole,)).tobytes()
            elif len(piece) > _SIDE_BY_SIDE:
                out[i] = array("i", merge(piece, self.ranks)).tobytes()
            else:
                groups.setdefault(-(-len(piece) // 8), []).append(i)
        for members in groups.values():
            for low in range(0, len(members), 1 << 13):
                self._side_by_side(pieces, members[low : low + (1 << 13)], out)
        return out

    def _side_by_side(self, pieces: list[bytes], members: list[int], out: list) -> None:
        sizes = np.array([len(pieces[i]) for i in members])
        wide = int(sizes.max())
        column = np.arange(wide + 1)
        inside = column[None, :wide] < sizes[:, None]
        ids = np.zeros((len(members), wide + 1), np.int64)
        ids[:, :wide][inside] = self.byte[np.frombuffer(b"".join(pieces[i] for i in members), np.uint8)]
        after = np.repeat(np.minimum(column + 1, wide)[None], len(members), 0)
        before = np.repeat((column - 1)[None], len(members), 0)
        ranks = np.full((len(members), wide + 1), _NONE, np.int64)
        paired = column[None, : wide - 1] < sizes[:, None] - 1
        ranks[:, : wide - 1][paired] = self._rank(ids[:, : wide - 1][paired], ids[:, 1:wide][paired])
        alive = np.zeros((len(members), wide + 1), bool)
        alive[:, :wide] = inside
        rows = np.arange(len(members))
        while len(rows):
            at = ranks[rows].argmin(1)
            best = ranks[rows, at]
            rows, at, best = rows[best < _NONE], at[best < _NONE], best[best < _NONE]
            gone = after[rows, at]
            following = after[rows, gone]
            ids[rows, at] = best
            alive[rows, gone] = False
            ranks[rows, gone] = _NONE
            after[rows, at] = following
            before[rows, following] = at
            right = alive[rows, following]
            ranks[rows, at] = np.where(right, self._rank(best, ids[rows, following]), _NONE)
            left = before[rows, at]
            has = left >= 0
            ranks[rows[has], left[has]] = self._rank(ids[rows[has], left[has]], best[has])
        flat = ids[alive].astype(np.int32).tobytes()
        ends = np.cumsum(alive.sum(1)).tolist()
        begin = 0
        for i, end in zip(members, ends):
            out[i] = flat[4 * begin : 4 * end]
            begin = end


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for one piece of any length: pairs in a heap over a linked list."""
    if piece in ranks:
        return [ranks[piece]]
    parts: list = [piece[i : i + 1] for i in range(len(piece))]
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []

    def offer(i):
        j = after[i]
        if j < n:
            rank = ranks.get(parts[i] + parts[j])
            if rank is not None:
                heapq.heappush(heap, (rank, i, len(parts[i]), len(parts[j])))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i] if parts[i] is not None else n
        if j >= n or len(parts[i]) != left or len(parts[j]) != right:
            continue
        parts[i] += parts[j]
        parts[j] = None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ranks[part] for part in parts if part is not None]


class Encoder:
    """Pieces to ids, with a bounded memory of pieces: those seen lately, and the generation before them.

    ``memory`` may be handed from task to task of a worker; it changes the time only.
    """

    def __init__(self, merges: Merges, pattern: str, memory: dict | None = None):
        import regex

        self.merges, self.cut = merges, regex.compile(pattern)
        self.memory = memory if memory is not None else {}
        self.memory.setdefault("lately", {})
        self.memory.setdefault("before", {})

    def coded(self, pieces: list[str]) -> list[bytes]:
        """Ids of the pieces, each as four bytes. Those not remembered are merged together."""
        out = list(map(self.memory["lately"].get, pieces))
        new = dict.fromkeys(piece for piece, ids in zip(pieces, out) if ids is None)
        if not new:
            return out
        before = self.memory["before"]
        unknown = [piece for piece in new if piece not in before]
        found = dict(zip(unknown, self.merges.ids_of([piece.encode("utf-8", "surrogatepass") for piece in unknown])))
        for piece in new:
            new[piece] = found[piece] if piece in found else before[piece]
        out = [new[piece] if ids is None else ids for piece, ids in zip(pieces, out)]
        self.memory["lately"].update(new)
        if len(self.memory["lately"]) >= REMEMBERED:
            self.memory["lately"], self.memory["before"] = {}, self.memory["lately"]
        return out

    def texts(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, each as four bytes."""
        cut = [self.cut.findall(text) for text in texts]
        coded = self.coded(list(chain.from_iterable(cut)))
        ends = list(accumulate(map(len, cut), initial=0))
        return [b"".join(coded[a:b]) for a, b in zip(ends, ends[1:])]

    def chunk(self, text: str, start: int, last: bool) -> dict:
        """Sure cuts (absolute), where the ids of each piece begin, and the ids. A piece is sure if a character follows it, or at the text's end.

        A run of blanks gives its last one up to a word that follows, so one character after the end decides. Pieces
        cover every character, so their lengths are the cuts.
        """
        pieces = self.cut.findall(text)
        if not last and pieces:
            pieces.pop()
        coded = self.coded(pieces)
        cuts = start + np.cumsum(np.fromiter(chain((0,), map(len, pieces)), np.int64, len(pieces) + 1))
        at = np.cumsum(np.fromiter(chain((0,), map(len, coded)), np.int64, len(pieces) + 1)) // 4
        return {"start": start, "text": text, "cuts": cuts, "at": at, "ids": np.frombuffer(b"".join(coded), np.int32)}


def stitch(chunks: Iterator[dict], encoder: Encoder, end: int) -> np.ndarray:
    """Ids of a whole text from its chunks in order, each as ``Encoder.chunk`` gives it."""
    out: list[np.ndarray] = []
    done, here = 0, None
    for chunk in chunks:
        if here is not None:
            common = np.intersect1d(here["cuts"], chunk["cuts"], assume_unique=False)
            common = common[common >= done]
            if not len(common):
                # One piece spans the overlap: cut again from the last sure cut to the end of this chunk.
                sure = int(here["cuts"][-1])
                out.append(_between(here, done, sure))
                text = here["text"][sure - here["start"] :] + chunk["text"][here["start"] + len(here["text"]) - chunk["start"] :]
                here, done = encoder.chunk(text, sure, chunk["start"] + len(chunk["text"]) >= end), sure
                continue
            out.append(_between(here, done, int(common[0])))
            done = int(common[0])
        here = chunk
    if here is not None:
        out.append(_between(here, done, int(here["cuts"][-1])))
    return np.concatenate([np.zeros(0, np.int32), *out])


def _between(chunk: dict, first: int, last: int) -> np.ndarray:
    """Ids of the pieces from one cut to another."""
    i, j = np.searchsorted(chunk["cuts"], [first, last])
    return chunk["ids"][chunk["at"][i] : chunk["at"][j]]


def encoded(docs: DataFrame, path: str, pattern: str, id_col="doc_id", text_col="text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id`` and ``ids`` of every row."""
    # A worker keeps the value between its tasks, and with it the memory of pieces.
    shared = docs.sparkSession.sparkContext.broadcast({"merges": Merges(read_ranks(path)), "memory": {}})
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def ids_column(all_ids: list) -> pa.Array:
        ends = np.cumsum([0, *(len(ids) // 4 for ids in all_ids)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(all_ids), np.int32)))

    def short(batches):
        encoder = Encoder(shared.value["merges"], pattern, shared.value["memory"])
        for batch in batches:
            for part in portions(batch, "text", TEXT_BYTES):
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), ids_column(encoder.texts(part.column(1).to_pylist()))], ["doc_id", "ids"]
                )

    def cut_up(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                text = one.column("text")[0].as_py()
                for number, start in enumerate(range(0, len(text), chunk)):
                    piece = text[start : start + chunk + overlap]
                    yield pa.RecordBatch.from_arrays(
                        [one.column("row"), one.column("doc_id"), pa.array([number], pa.int32()), pa.array([start], pa.int64()), pa.array([len(text)], pa.int64()), pa.array([piece], pa.string())],
                        ["row", "doc_id", "number", "start", "total", "piece"],
                    )

    def in_chunks(batches):
        encoder = Encoder(shared.value["merges"], pattern, shared.value["memory"])
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                text, start, total = (one.column(c)[0].as_py() for c in ("piece", "start", "total"))
                found = encoder.chunk(text, start, start + len(text) >= total)
                packed = [pa.array([found[name].tobytes()], pa.binary()) for name in ("cuts", "at", "ids")]
                yield pa.RecordBatch.from_arrays([*one.columns, *packed], [*one.schema.names, "cuts", "at", "ids"])

    def joined(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table.column("number").to_numpy())))

        def parts():
            for row in range(table.num_rows):
                packed = {name: table.column(name)[row].as_py() for name in ("start", "piece", "cuts", "at", "ids")}
                yield {
                    "start": packed["start"], "text": packed["piece"], "ids": np.frombuffer(packed["ids"], np.int32),
                    "cuts": np.frombuffer(packed["cuts"], np.int64), "at": np.frombuffer(packed["at"], np.int64),
                }

        encoder = Encoder(shared.value["merges"], pattern, shared.value["memory"])
        ids = stitch(parts(), encoder, table.column("total")[0].as_py())
        return pa.table([table.column("doc_id").slice(0, 1), ids_column([ids.tobytes()])], ["doc_id", "ids"])

    result = f"doc_id {kind}, ids array<int>"
    small = rows.where(F.char_length("text") <= chunk).mapInArrow(short, result)
    cut_schema = f"row bigint, doc_id {kind}, number int, start bigint, total bigint, piece string"
    large = rows.where(F.char_length("text") > chunk).withColumn("row", F.monotonically_increasing_id())
    pieces = large.mapInArrow(cut_up, cut_schema).repartition("row", "number")
    coded = pieces.mapInArrow(in_chunks, f"{cut_schema}, cuts binary, at binary, ids binary")
    return small.unionByName(coded.groupBy("row").applyInArrow(joined, result))


def decoded(coded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """The rows with the ``bytes`` that their ids stand for, in place of a column of that name. Null ids stand for none."""
    coded = coded.drop("bytes")
    tokens = [b""] * (max((ranks := read_ranks(path)).values()) + 1)
    for token, i in ranks.items():
        tokens[i] = token
    shared = coded.sparkSession.sparkContext.broadcast(
        {"bytes": np.frombuffer(b"".join(tokens), np.uint8), "begin": np.concatenate(([0], np.cumsum([len(t) for t in tokens])))}
    )
    names = [f.name for f in coded.schema.fields]

    def run(batches):
        table, begin = shared.value["bytes"], shared.value["begin"]
        for batch in batches:
            column = batch.column(batch.schema.names.index(ids_col))
            counts = np.array([len(x) if x.is_valid else 0 for x in column], np.int64)
            before = np.concatenate(([0], np.cumsum(counts)))
            first = 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(before, before[first] + AT_ONCE, "right")) - 1)
                part = batch.slice(first, last - first)
                flat = part.column(batch.schema.names.index(ids_col)).flatten().to_numpy(zero_copy_only=False)
                sizes = begin[flat + 1] - begin[flat]
                ends = np.concatenate(([0], np.cumsum(sizes)))
                out = table[np.repeat(begin[flat] - ends[:-1], sizes) + np.arange(ends[-1])]
                at = ends[before[first : last + 1] - before[first]].astype(np.int64)
                whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), last - first, [None, pa.py_buffer(at), pa.py_buffer(out)])
                yield pa.RecordBatch.from_arrays([*part.columns, whole.cast(pa.binary())], [*names, "bytes"])
                first = last

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema.fields)
    return coded.mapInArrow(run, f"{schema}, bytes binary")
