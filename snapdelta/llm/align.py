"""Alignment of two tokenizers' outputs over the same bytes, by merge-path partitioning.

Every text is tokenised by A (byte-level BPE) and B (pieces with byte fallback). A token ends at a byte offset; the two sorted
lists of ends are merged. The merge of a document is divided along diagonals: diagonal d crosses the merge path where d ends
lie before it, and a binary search per diagonal finds the crossing. Pieces between neighbouring diagonals have equal work,
know nothing of each other, and go to different tasks. A cut that would part two equal ends is moved past both, so a common
end lies whole in one piece. A piece emits the pairs of tokens that end together and the groups that it closes; a group that
goes over a boundary leaves an open tail and a head, which are stitched in the order of the pieces.

Two tokens that end together have bytes of which one is a suffix of the other. So the pairs that can ever be linked follow from
the two vocabularies: they are numbered once on the driver, and counts of all pairs are a list of that fixed length, whatever
the data. Only such lists are sent around; no token is shuffled, but for documents of several pieces.

Defined results: null and empty texts, and texts whose tokens do not spell a space and the text, have no tokens: zeros and an
empty ``groups``. Every row is aligned by itself, so rows that repeat or share an id (null too) give a row each, and each counts
in the corpus. A pair as frequent as another of its B token is a best one too. Extra columns are left out; their names do not
matter. An empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapdelta.llm.wordhash import portions, texts_of
from snapdelta.session import settled

# Ends in one piece; a text of about 20 KB.
PIECE = 16_384
# Bytes of text that are tokenised at once, and tokens that are aligned at once.
TEXT_BYTES = 1 << 20
TOKENS = 1 << 18
# Words whose pieces a worker remembers.
REMEMBERED = 100_000
# Sets the ends of one row apart from those of the next; no text is that long.
_APART = 1 << 40

A_FILE = "byte_bpe_50k.json"
B_FILE = "piece_bpe_32k.model"


def token_files() -> tuple[str, str, str]:
    """Paths of the two public vocabularies, and the pattern by which A cuts a text."""
    import public_tokenizers

    return public_tokenizers.path(A_FILE), public_tokenizers.path(B_FILE), public_tokenizers.PATTERN


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def _bytes_of_a(text: str) -> list[bytes]:
    letters = _byte_letters()
    whole = json.loads(text)
    found = {i: bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode() for token, i in whole["model"]["vocab"].items()}
    found |= {added["id"]: added["content"].encode() for added in whole.get("added_tokens", [])}
    return [found.get(i, b"") for i in range(max(found) + 1)]


def _bytes_of_b(processor) -> list[bytes]:
    def spelt(i: int) -> bytes:
        piece = processor.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if processor.is_byte(i) else piece.replace("▁", " ").encode()

    return [spelt(i) for i in range(processor.get_piece_size())]


def linkable(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Sorted numbers ``a * len(b) + b`` of all pairs that can end together: one is a suffix of the other."""
    by_bytes: tuple[dict, dict] = {}, {}
    for side, tokens in zip(by_bytes, (a, b)):
        for i, token in enumerate(tokens):
            side.setdefault(token, []).append(i)
    pairs = set()
    for i, token in enumerate(a):
        pairs.update(i * len(b) + j for cut in range(len(token)) for j in by_bytes[1].get(token[cut:], ()))
    for j, token in enumerate(b):
        pairs.update(i * len(b) + j for cut in range(1, len(token)) for i in by_bytes[0].get(token[cut:], ()))
    return np.array(sorted(pairs), np.int64)


def _ranks(text: str, tokens: list[bytes]) -> dict[bytes, int] | None:
    """Id of each token that is merged or a byte, if ids are in the order of the merges and so serve as ranks."""
    whole = json.loads(text)
    ids = whole["model"]["vocab"]
    made = [ids["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in whole["model"]["merges"]]
    if made != sorted(made):
        return None
    added = {x["id"] for x in whole.get("added_tokens", [])}
    return {token: i for i, token in enumerate(tokens) if token and i not in added}


class Tables:
    """Bytes of all tokens of a vocabulary end to end, and where each begins."""

    def __init__(self, tokens: list[bytes]):
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.begin = np.concatenate(([0], np.cumsum([len(t) for t in tokens]))).astype(np.int64)
        self.sizes = np.diff(self.begin)

    def spelt(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.sizes[ids]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        return self.data[np.repeat(self.begin[ids] - ends[:-1], sizes) + np.arange(ends[-1])]


class Pair:
    """The two tokenizers, built from the contents of their files, so that executors need no file."""

    def __init__(self, a_path: str, b_path: str, pattern: str):
        with open(a_path, encoding="utf-8") as file:
            self.a_text = file.read()
        with open(b_path, "rb") as file:
            self.b_model = file.read()
        self.pattern = pattern
        a, b = _bytes_of_a(self.a_text), _bytes_of_b(self.second)
        self.a, self.b = Tables(a), Tables(b)
        self.kinds = [np.dtype(np.uint16 if len(x) <= 1 << 16 else np.int32) for x in (a, b)]
        self.pairs = linkable(a, b)
        self.digits = Tables([str(i).encode() for i in range(max(len(a), len(b)))])
        self.ranks = _ranks(self.a_text, a)
        self.words = {}

    def __getstate__(self):
        # Tokenizers are built by each worker.
        return {name: value for name, value in self.__dict__.items() if name not in ("first", "whole", "second", "words")} | {"words": {}}

    @cached_property
    def first(self):
        """A over its ranks, which is faster than by its file."""
        import tiktoken

        return tiktoken.Encoding("a", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})

    @cached_property
    def whole(self):
        """A by its own file, for what the other form refuses."""
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        found = Tokenizer.from_str(self.a_text)
        found.encode_special_tokens = True
        return found

    @cached_property
    def second(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.b_model)

    def _ids_a(self, text: str) -> np.ndarray:
        if self.ranks is None:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.kinds[0])
        try:
            ids = self.first.encode_ordinary(text)
        except BaseException as error:
            # A panic of the library on a text that its pattern engine cannot take.
            if isinstance(error, (KeyboardInterrupt, SystemExit)):
                raise
            ids = self.whole.encode(text, add_special_tokens=False).ids
        return np.array(ids, self.kinds[0])

    def _ids_b(self, text: str) -> np.ndarray:
        """B's ids. No piece goes on after its word into a blank, so words between single blanks are encoded each for itself and remembered."""
        if "  " in text or "\u2581" in text or text[0] == " " or text[-1] == " ":
            return np.array(self.second.encode(text), self.kinds[1])
        known, ids = self.words, []
        for word in text.split(" "):
            found = known.get(word)
            if found is None:
                found = self.second.encode(word)
                if len(known) >= REMEMBERED:
                    known.clear()
                if len(word) <= 64:
                    known[word] = found
            ids += found
        return np.array(ids, self.kinds[1])

    def tokenised(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A's ids and where each text's begin, and B's. Texts that either does not spell have none."""
        strings = texts.to_pylist()
        data, at = texts_of(texts)
        full = np.diff(at) > 0
        # What the tokens must spell: a blank before each text that has bytes.
        want = np.insert(data, at[:-1][full], 32)
        begin = at + np.concatenate(([0], np.cumsum(full)))
        sides = []
        good = np.ones(len(strings), bool)
        for kind, table, ids_of in zip(self.kinds, (self.a, self.b), (lambda t: self._ids_a(f" {t}"), self._ids_b)):
            ids = [ids_of(t) if t else np.zeros(0, kind) for t in strings]
            sides.append(ids)
            flat = np.concatenate([np.zeros(0, kind), *ids])
            got = table.spelt(flat)
            if len(got) == len(want) and (got == want).all():
                continue
            ends = np.concatenate(([0], np.cumsum(table.sizes[flat])))[np.cumsum([0, *map(len, ids)])]
            good &= [np.array_equal(got[ends[i] : ends[i + 1]], want[begin[i] : begin[i + 1]]) for i in range(len(ids))]
        out = []
        for kind, ids in zip(self.kinds, sides):
            ids = [x if ok else x[:0] for x, ok in zip(ids, good)]
            out += [np.concatenate([np.zeros(0, kind), *ids]), np.cumsum([0, *map(len, ids)]).astype(np.int64)]
        return tuple(out)


def diagonal_cuts(ends_a: np.ndarray, ends_b: np.ndarray, work: int) -> list[tuple[int, int]]:
    """Where to cut both lists into pieces of about ``work`` ends, the first and last place included."""
    total = len(ends_a) + len(ends_b)
    diagonals = np.arange(work, total, work)
    low, high = np.maximum(diagonals - len(ends_b), 0), np.minimum(diagonals, len(ends_a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        before = np.zeros(len(diagonals), bool)
        before[open_] = ends_a[middle[open_]] <= ends_b[diagonals[open_] - 1 - middle[open_]]
        low = np.where(open_ & before, middle + 1, low)
        high = np.where(open_ & ~before, middle, high)
    cuts = [(0, 0)]
    for i, j in zip(low.tolist(), (diagonals - low).tolist()):
        if 0 < i and j < len(ends_b) and ends_a[i - 1] == ends_b[j]:
            j += 1
        if (i, j) != cuts[-1]:
            cuts.append((i, j))
    end = (len(ends_a), len(ends_b))
    return cuts if cuts[-1] == end else [*cuts, end]


def _ends(ids: np.ndarray, at: np.ndarray, sizes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Byte offset of each token's end, rows set apart."""
    rows = np.diff(at)
    ends = np.concatenate(([0], np.cumsum(sizes[ids])))
    return ends[1:] + np.repeat(begin + np.arange(len(rows)) * _APART - ends[at[:-1]], rows)


class Piece:
    """The merged ends of some rows: which tokens of either side end where one of the other does."""

    def __init__(self, pair: Pair, a, at_a, begin_a, b, at_b, begin_b):
        self.pair, self.a, self.at_a, self.b, self.at_b = pair, a, at_a, b, at_b
        ends_a, ends_b = _ends(a, at_a, pair.a.sizes, begin_a), _ends(b, at_b, pair.b.sizes, begin_b)
        place = np.searchsorted(ends_b, ends_a)
        self.hit_a = np.zeros(len(a), bool)
        near = place < len(b)
        self.hit_a[near] = ends_b[place[near]] == ends_a[near]
        self.hit_b = np.zeros(len(b), bool)
        self.hit_b[place[self.hit_a]] = True

    def links(self) -> np.ndarray:
        """The number of the pair of every link, in order."""
        names = self.a[self.hit_a].astype(np.int64) * len(self.pair.b.sizes) + self.b[self.hit_b]
        return np.searchsorted(self.pair.pairs, names)

    def links_before(self) -> np.ndarray:
        """Number of links before each row, with the total last."""
        return np.concatenate(([0], np.cumsum(self.hit_a)))[self.at_a]

    def inner(self, row: int, first: bool) -> tuple[slice, slice, slice, slice]:
        """Of one row with links: for A and for B the head up to the first common end (none in a first piece), and the rest up to the last."""
        out = []
        for at, hit in ((self.at_a, self.hit_a), (self.at_b, self.hit_b)):
            low, high = int(at[row]), int(at[row + 1])
            hits = np.flatnonzero(hit[low:high])
            begin = low if first else low + int(hits[0]) + 1
            out += [slice(low, begin), slice(begin, low + int(hits[-1]) + 1)]
        return tuple(out)

    def spelt(self, part_a: slice, part_b: slice) -> tuple[np.ndarray, np.ndarray]:
        """Text of the groups of a stretch that starts and ends at common ends, and where each token of it begins, groups in order."""
        a, b, hit_a, hit_b = self.a[part_a], self.b[part_b], self.hit_a[part_a], self.hit_b[part_b]
        group_a, group_b = np.cumsum(hit_a) - hit_a, np.cumsum(hit_b) - hit_b
        last_a, last_b = np.flatnonzero(hit_a) + 1, np.flatnonzero(hit_b) + 1
        before_a, before_b = last_a, np.concatenate(([0], last_b))
        tokens = np.zeros(len(a) + len(b), np.int64)
        marks = np.full(len(tokens), ord(","), np.uint8)
        at_a, at_b = np.arange(len(a)) + before_b[group_a], np.arange(len(b)) + before_a[group_b]
        tokens[at_a], tokens[at_b] = a, b
        marks[at_a[hit_a]], marks[at_b[hit_b]] = ord("|"), ord(";")
        digits = self.pair.digits
        sizes = digits.sizes[tokens]
        ends = np.cumsum(sizes + 1)
        out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
        starts = ends - sizes - 1
        inside = np.ones(len(out), bool)
        inside[ends - 1] = False
        spelt = np.concatenate(([0], np.cumsum(sizes)))
        out[inside] = digits.data[np.repeat(digits.begin[tokens] - spelt[:-1], sizes) + np.arange(spelt[-1])]
        out[ends - 1] = marks
        return out, np.append(starts, len(out))


_TOKEN_COLUMNS = "piece int, pieces int, a binary, a_from bigint, b binary, b_from bigint"


def _packed(ids: np.ndarray, at: np.ndarray) -> pa.Array:
    places = (at * ids.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(places), pa.py_buffer(ids)])


def _unpacked(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    data, at = texts_of(column)
    return np.frombuffer(data.tobytes(), kind), at // kind.itemsize


def tokenised(docs: DataFrame, shared, id_col: str = "doc_id", text_col: str = "text", work: int = PIECE) -> DataFrame:
    """Both tokenizers' ids of every row, packed, a row for each piece: ``key`` names the document, ``a_from`` and ``b_from`` the first bytes."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        pair = shared.value
        for batch in batches:
            for part in portions(batch, "text", TEXT_BYTES):
                a, at_a, b, at_b = pair.tokenised(part.column(2))
                rows, numbers, counts, cuts = [], [], [], []
                for i in range(part.num_rows):
                    own_a, own_b = slice(at_a[i], at_a[i + 1]), slice(at_b[i], at_b[i + 1])
                    places = [(0, 0), (own_a.stop - own_a.start, own_b.stop - own_b.start)]
                    ends = np.zeros(1, np.int64), np.zeros(1, np.int64)
                    if sum(places[1]) > work:
                        ends = tuple(np.concatenate(([0], np.cumsum(t.sizes[x[own]]))) for t, x, own in ((pair.a, a, own_a), (pair.b, b, own_b)))
                        places = diagonal_cuts(ends[0][1:], ends[1][1:], work)
                    for number, (one, two) in enumerate(zip(places, places[1:])):
                        rows.append(i)
                        numbers.append(number)
                        counts.append(len(places) - 1)
                        cuts.append((own_a.start + two[0], own_b.start + two[1], ends[0][one[0]], ends[1][one[1]]))
                cuts = np.array(cuts, np.int64).reshape(-1, 4)
                lists = [_packed(x, np.concatenate(([0], cuts[:, k]))) for k, x in enumerate((a, b))]
                taken = part.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [taken.column(0), taken.column(1), pa.array(numbers, pa.int32()), pa.array(counts, pa.int32()), lists[0], pa.array(cuts[:, 2]), lists[1], pa.array(cuts[:, 3])],
                    ["key", "doc_id", "piece", "pieces", "a", "a_from", "b", "b_from"],
                )

    return rows.mapInArrow(run, f"key bigint, doc_id {kind}, {_TOKEN_COLUMNS}")


def _merged(batch: pa.RecordBatch, pair: Pair) -> Iterator[tuple[pa.RecordBatch, Piece]]:
    """Stretches of a batch of some ``TOKENS`` tokens, at least one row each, with their merged ends."""
    names = batch.schema.names
    column = lambda part, name: part.column(names.index(name))
    before = sum(texts_of(column(batch, side))[1] // kind.itemsize for side, kind in zip("ab", pair.kinds))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(before, before[first] + TOKENS, "right")) - 1)
        part = batch.slice(first, last - first)
        sides = []
        for side, kind in zip("ab", pair.kinds):
            sides += [*_unpacked(column(part, side), kind), column(part, f"{side}_from").to_numpy()]
        yield part, Piece(pair, *sides)
        first = last


def pair_counts(tokens: DataFrame, shared) -> np.ndarray:
    """How many links of all documents hold each linkable pair: one number per pair of the fixed list."""

    def run(batches):
        pair = shared.value
        counts = np.zeros(len(pair.pairs), np.int64)
        for batch in batches:
            for _, piece in _merged(batch, pair):
                counts += np.bincount(piece.links(), minlength=len(counts))
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(counts[seen])], ["pair", "n"])

    found = tokens.select("a", "a_from", "b", "b_from").mapInArrow(run, "pair int, n bigint")
    table = found.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(shared.value.pairs), np.int64)
    counts[table.column("pair").to_numpy()] = table.column("n").to_numpy()
    return counts


def _text_column(data: np.ndarray, at: np.ndarray) -> pa.Array:
    whole = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data))
    return whole.cast(pa.string())


_FIGURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def _figures(piece: Piece, counts: np.ndarray, best: np.ndarray) -> list[pa.Array]:
    links = piece.links()
    before = piece.links_before()
    n = np.diff(before)
    of_links = [np.diff(np.concatenate(([0], np.cumsum(x)))[before]) for x in (best[links].astype(np.int64), counts[links])]
    return [pa.array(x) for x in (np.diff(piece.at_a), np.diff(piece.at_b), n, n, *of_links)]


def aligned(docs: DataFrame, a_path: str, b_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", work: int = PIECE) -> DataFrame:
    """Per row: ``doc_id``, numbers of tokens, groups and links, ``n_best``, ``count_sum`` and the ``groups`` as ``a1,a2|b1;a3|b2,b3``."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(Pair(a_path, b_path, pattern))
    tokens = settled(tokenised(docs, shared, id_col, text_col, work), "align-tokens")
    kind = tokens.schema["doc_id"].dataType.simpleString()
    counts = pair_counts(tokens, shared)
    of_b = shared.value.pairs % len(shared.value.b.sizes)
    highest = np.zeros(len(shared.value.b.sizes), np.int64)
    np.maximum.at(highest, of_b, counts)
    tallied = context.broadcast((counts, counts == highest[of_b]))
    figures = ", ".join(f"{name} bigint" for name in _FIGURES)

    def whole(batches):
        pair, (n, best) = shared.value, tallied.value
        for batch in batches:
            for part, piece in _merged(batch, pair):
                text, starts = piece.spelt(slice(None), slice(None))
                at = starts[piece.at_a + piece.at_b]
                # The mark after a row's last group goes; all stay in place but for it.
                filled = np.diff(at) > 0
                stays = np.ones(len(text), bool)
                stays[at[1:][filled] - 1] = False
                at = at - np.concatenate(([0], np.cumsum(filled)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.names.index("doc_id")), *_figures(piece, n, best), _text_column(text[stays], at)], ["doc_id", *_FIGURES, "groups"]
                )

    def in_pieces(batches):
        pair, (n, best) = shared.value, tallied.value
        for batch in batches:
            for part, piece in _merged(batch, pair):
                numbers = part.column(part.schema.names.index("piece")).to_numpy()
                texts, lists, closed = [], {name: [] for name in ("head_a", "head_b", "tail_a", "tail_b")}, []
                for row in range(part.num_rows):
                    low_a, high_a, low_b, high_b = *piece.at_a[row : row + 2], *piece.at_b[row : row + 2]
                    closed.append(bool(piece.hit_a[low_a:high_a].any()))
                    head_a = head_b = slice(0, 0)
                    end_a, end_b, text = low_a, low_b, b""
                    if closed[-1]:
                        head_a, body_a, head_b, body_b = piece.inner(row, numbers[row] == 0)
                        text = piece.spelt(body_a, body_b)[0].tobytes()
                        end_a, end_b = body_a.stop, body_b.stop
                    texts.append(text.decode())
                    for name, ids in (("head_a", piece.a[head_a]), ("head_b", piece.b[head_b]), ("tail_a", piece.a[end_a:high_a]), ("tail_b", piece.b[end_b:high_b])):
                        lists[name].append(ids)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(part.schema.names.index(c)) for c in ("key", "doc_id", "piece")), *_figures(piece, n, best), pa.array(closed), pa.array(texts, pa.string()), *(pa.array(x, pa.list_(pa.int32())) for x in lists.values())],
                    ["key", "doc_id", "piece", *_FIGURES, "closed", "text", *lists],
                )

    def stitched(batches):
        """Groups of each document whose pieces come one after the other."""
        now, parts, open_ = None, [], [[], []]

        def done():
            text = "".join(parts)[:-1]
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([text], pa.string())], ["key", "groups"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["key"] != now:
                    if now is not None:
                        yield done()
                    now, parts, open_ = row["key"], [], [[], []]
                if row["closed"]:
                    if row["piece"]:
                        sides = [",".join(map(str, carried + row[f"head_{side}"])) for side, carried in zip("ab", open_)]
                        parts.append("|".join(sides) + ";")
                        open_ = [[], []]
                    parts.append(row["text"])
                open_ = [carried + row[f"tail_{side}"] for side, carried in zip("ab", open_)]
        if now is not None:
            yield done()

    small = tokens.where("pieces = 1").mapInArrow(whole, f"doc_id {kind}, {figures}, groups string")
    lists = "head_a array<int>, head_b array<int>, tail_a array<int>, tail_b array<int>"
    cut = tokens.where("pieces > 1").repartition("key", "piece").mapInArrow(in_pieces, f"key bigint, doc_id {kind}, piece int, {figures}, closed boolean, text string, {lists}")
    cut = settled(cut, "align-pieces")
    sums = cut.groupBy("key").agg(F.any_value("doc_id").alias("doc_id"), *[F.sum(name).alias(name) for name in _FIGURES])
    order = cut.select("key", "piece", "closed", "text", "head_a", "head_b", "tail_a", "tail_b").repartition("key").sortWithinPartitions("key", "piece")
    large = sums.join(order.mapInArrow(stitched, "key bigint, groups string"), "key").select("doc_id", *_FIGURES, "groups")
    return small.unionByName(large)
