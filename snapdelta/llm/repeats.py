"""Suffix-array dedup: bytes covered by a long string that also starts earlier are removed.

Every string of ``length`` bytes (a window) has an anchor: the leftmost of its least hashed 24-byte substrings. Equal windows
have equal anchors, so windows are grouped by anchor without comparing all with all: consecutive windows with one anchor are
a segment of at most 176 bytes. Documents are dealt into blocks of bounded size by their text, those of a frequent text by id too, and

1. a block sends its distinct anchor hashes; those that two blocks hold are answered (an anchor within one block counts too);
2. a block sends its distinct segments that have a repeated anchor, each with its first position;
3. where these meet, equal segments become one with the earliest position, and a run-length index (``runindex``) over the
   segments of shared anchors streams matching statistics and tells which windows occur in no earlier segment; windows whose
   own hash comes only once stay and are not indexed;
4. a block gets the windows that stay for the segments it owns; all other windows with a repeated anchor are repeats.

Texts are compared as bytes throughout; hashes only bring candidates together. A passage that is frequent costs a block one entry,
and meets once per block, not once per copy. Of equal texts in a block all but the first are repeats as a whole and have no segments.

Order is by ``doc_id`` (nulls first), then a hash of the text for rows that share an id, then the start. Defined results: a null
text is empty; texts shorter than ``length`` lose nothing; rows that agree in id and text are one document and get equal results.
Matches never cross documents. Extra columns are left out. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapdelta.llm import wordhash
from snapdelta.llm.common import pieces
from snapdelta.llm.lm import _buckets
from snapdelta.llm.runindex import RunIndex

LENGTH = 100
ANCHOR = 24
BLOCK_BYTES = 12 << 20
BUCKET_BYTES = 6 << 20
INDEX_BYTES = 1 << 18
_SEGMENT = 1 << 17
_LOW = np.uint64((1 << 20) - 1)

_random = np.random.default_rng(91)
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def _power(k: int) -> np.uint64:
    return np.uint64(pow(_BASE, k, 1 << 64))


def _names(hashes: np.ndarray) -> np.ndarray:
    """Names of anchors, evenly spread: an anchor's hash is a minimum, and minima crowd at the low end, in a few buckets."""
    return wordhash.mix(hashes)


def _hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` bytes from each position on, by doubling."""
    part, size, out, have = _BYTE[data], 1, None, 0
    while True:
        if width & size:
            # The part goes in front of what is there already.
            out = part if out is None else part[: len(data) - have - size + 1] * _power(have) + out[size:]
            have += size
        if have == width:
            return wordhash.mix(out)
        part = part[:-size] * _power(size) + part[size:]
        size *= 2


def _anchor_hashes(data: np.ndarray) -> np.ndarray:
    return _hashes(data, ANCHOR)


def _again(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of segments given end to end, the first window and the end of windows whose hash comes again in any; none: end 0.

    A window outside of these has no equal one, so it need not be indexed.
    """
    hashes = _hashes(data, length)
    windows = sizes - length + 1
    item = np.repeat(np.arange(len(sizes)), windows)
    place = np.arange(len(item)) - np.repeat(np.cumsum(windows) - windows, windows)
    hashes = hashes[begins[item] + place]
    ranked = np.sort(hashes)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    first, end = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    if len(twice):
        again = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, hashes), len(twice) - 1)] == hashes)
        first[item[again[::-1]]] = place[again[::-1]]
        end[item[again]] = place[again] + 1
    return first, end


def segments(data: np.ndarray, at: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of windows with one anchor: first and last window start, and the anchor's name.

    ``data`` holds texts end to end, ``at`` their starts with the total last.
    """
    n = len(data)
    firsts, lasts, hashes = [], [], []
    tail = length - 1
    for begin in range(0, max(0, n - tail), _SEGMENT):
        end = min(begin + _SEGMENT, n - tail)  # window starts
        part = data[begin : end + tail]
        anchors = _anchor_hashes(part)
        keys = (anchors & ~_LOW) | np.arange(len(anchors), dtype=np.uint64)
        span, least = length - ANCHOR + 1, keys
        width = 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        place = (least & _LOW).astype(np.int64)
        valid = np.ones(len(place), bool)
        ends = at[np.searchsorted(at, begin, "right") : np.searchsorted(at, end + tail, "right")]
        for stop in (ends - begin).tolist():
            valid[max(0, stop - tail) : max(0, stop)] = False
        change = np.ones(len(place), bool)
        change[1:] = (place[1:] != place[:-1]) | (valid[1:] != valid[:-1])
        starts = np.flatnonzero(change)
        stops = np.append(starts[1:], len(place)) - 1
        good = valid[starts]
        firsts.append(starts[good] + begin)
        lasts.append(stops[good] + begin)
        hashes.append(_names(anchors[place[starts[good]]]))
    if not firsts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(firsts), np.concatenate(lasts), np.concatenate(hashes)


def _anchor_place(text: bytes, anchor: np.uint64) -> int:
    """Where the anchor of a segment lies: at the first substring with its name."""
    return int(np.flatnonzero(_names(_anchor_hashes(np.frombuffer(text, np.uint8))) == anchor)[0])


class Block:
    """A block's distinct texts in the order of their first documents, as bytes end to end, and their segments.

    Later documents with the same text, ``copies_of`` by id, are repeats as a whole.
    """

    def __init__(self, table: pa.Table, length: int):
        ids = table.column("doc_id").to_pylist()
        ties = table.column("tie").to_pylist()
        least = min((i for i in ids if i is not None), default=0)
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, least if ids[i] is None else ids[i], ties[i]))
        texts = table.column("text").combine_chunks()
        data, at = wordhash.texts_of(texts)
        self.rows_of: list[list] = []
        self.copies_of: list[list] = []
        distinct, of_tie, before, into = [], {}, None, []
        for i in order:
            if before != (ids[i], ties[i]):
                before = ids[i], ties[i]
                alike = of_tie.setdefault(ties[i], [])
                text = data[at[i] : at[i + 1]]
                k = next((k for k in alike if np.array_equal(text, data[at[distinct[k]] : at[distinct[k] + 1]])), None)
                if k is None:
                    alike.append(len(distinct))
                    distinct.append(i)
                    self.rows_of.append([])
                    self.copies_of.append([])
                    into = self.rows_of[-1]
                else:
                    into = self.copies_of[k]
            into.append(ids[i])
        self.ids, self.ties = [ids[i] for i in distinct], [ties[i] for i in distinct]
        self.data, self.at = wordhash.texts_of(texts.take(pa.array(distinct, pa.int64())))
        self.first, self.last, self.anchor = segments(self.data, self.at, length)


def _asks(table: pa.Table, buckets: int, length: int) -> pa.Table:
    block = table.column("block")[0].as_py()
    keys = np.unique(Block(table, length).anchor)
    at = _buckets(keys, buckets)
    full = [b for b in range(buckets) if at[b] < at[b + 1]]
    packs = [keys[at[b] : at[b + 1]].tobytes() for b in full]
    return pa.table([pa.array(full, pa.int32()), pa.array([block] * len(full), pa.int32()), pa.array(packs, pa.binary())], ["bucket", "block", "keys"])


def _shared_anchors(table: pa.Table) -> pa.Table:
    """To each block, its anchors that another block holds too."""
    packs = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("keys")]
    keys = np.concatenate(packs)
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    twice = np.zeros(len(keys), bool)
    twice[1:] = ranked[1:] == ranked[:-1]
    twice[:-1] |= twice[1:]
    found = np.empty(len(keys), bool)
    found[order] = twice
    blocks, out, at = [], [], 0
    for block, pack in zip(table.column("block").to_pylist(), packs):
        mine = found[at : at + len(pack)]
        at += len(pack)
        if mine.any():
            blocks.append(block)
            out.append(pack[mine].tobytes())
    return pa.table([pa.array(blocks, pa.int32()), pa.array(out, pa.binary())], ["block", "keys"])


def _repeated(block: Block, answers: pa.Table) -> np.ndarray:
    """Which segments have an anchor that occurs more than once, here or elsewhere."""
    order = np.argsort(block.anchor, kind="stable")
    ranked = block.anchor[order]
    twice = np.zeros(len(ranked), bool)
    if len(ranked):
        twice[1:] = ranked[1:] == ranked[:-1]
        twice[:-1] |= twice[1:]
    # One search among the answers of all buckets: one per bucket would make a block's work grow with the corpus.
    packs = [np.frombuffer(x.as_py(), np.uint64) for x in answers.column("keys") if x.is_valid]
    if packs:
        asked = np.sort(np.concatenate(packs))
        twice |= asked[np.minimum(np.searchsorted(asked, ranked), len(asked) - 1)] == ranked
    out = np.empty(len(ranked), bool)
    out[order] = twice
    return out


_FIELDS = ("bucket", "block", "anchors", "sizes", "texts", "starts", "places", "ranks", "ids", "known", "ties")
_SENT = "bucket int, block int, anchors binary, sizes binary, texts binary, starts binary, places binary, ranks binary, ids binary, known binary, ties binary"


def _packed(data: bytes) -> bytes:
    """Compressed, the length in front: segments overlap and are text, so they shrink to well under half."""
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _sends(table: pa.Table, answers: pa.Table, buckets: int, length: int) -> pa.Table:
    """A block's distinct segments with repeated anchors and the first position of each."""
    out: dict[str, list] = {name: [] for name in _FIELDS}
    types = [pa.int32(), pa.int32(), *[pa.binary()] * 9]
    if table.num_rows:
        number = table.column("block")[0].as_py()
        block = Block(table, length)
        chosen = np.flatnonzero(_repeated(block, answers))
        raw = block.data.tobytes()
        seen: dict[bytes, int] = {}
        for i, first, last in zip(chosen.tolist(), block.first[chosen].tolist(), block.last[chosen].tolist()):
            seen.setdefault(raw[first : last + length], i)
        index = np.fromiter(seen.values(), np.int64, len(seen))
        texts = list(seen)
        order = np.argsort(block.anchor[index], kind="stable")
        index = index[order]
        anchors = block.anchor[index]
        ranks = np.searchsorted(block.at, block.first[index], "right") - 1
        starts = block.first[index] - block.at[ranks]
        ids = np.array([0 if i is None else i for i in block.ids], np.int64)
        known = np.array([i is not None for i in block.ids], np.uint8)
        ties = np.array(block.ties, np.int64)
        at = _buckets(anchors, buckets)
        for bucket in range(buckets):
            a, b = at[bucket], at[bucket + 1]
            if a == b:
                continue
            own = [texts[k] for k in order[a:b]]
            # Documents of the pack are told once; a segment has the place of its document among them.
            rank, place = np.unique(ranks[a:b], return_inverse=True)
            values = (
                bucket, number, anchors[a:b].tobytes(), np.fromiter(map(len, own), np.uint8, len(own)).tobytes(), _packed(b"".join(own)),
                _packed(starts[a:b].astype(np.int64).tobytes()), _packed(place.astype(np.int32).tobytes()),
                rank.astype(np.int64).tobytes(), ids[rank].tobytes(), known[rank].tobytes(), ties[rank].tobytes(),
            )
            for name, value in zip(_FIELDS, values):
                out[name].append(value)
    return pa.table([pa.array(out[name], t) for name, t in zip(_FIELDS, types)], list(_FIELDS))


def _stay(table: pa.Table, length: int, index_bytes: int) -> pa.Table:
    """For the earliest copy of each segment, the windows that occur in no earlier segment, as bits; to the owning blocks."""

    def column(name, kind, opened=lambda x: x):
        return [np.frombuffer(opened(x.as_py()), kind) for x in table.column(name)]

    sizes = np.concatenate(column("sizes", np.uint8)).astype(np.int64)
    anchors, starts = np.concatenate(column("anchors", np.uint64)), np.concatenate(column("starts", np.int64, _unpacked))
    places = column("places", np.int32, _unpacked)
    known, ids, ties, ranks = (
        np.concatenate([of[at] for of, at in zip(column(name, kind), places)])
        for name, kind in (("known", np.uint8), ("ids", np.int64), ("ties", np.int64), ("ranks", np.int64))
    )
    blocks = np.repeat(table.column("block").to_numpy(), [len(at) for at in places])
    raw = b"".join(_unpacked(x.as_py()) for x in table.column("texts"))
    begins = np.concatenate(([0], np.cumsum(sizes)))
    # Earliest first, so the first text seen is the one that owns its copies.
    order = np.lexsort((starts, ties, ids, known))
    owners: dict[bytes, int] = {}
    for i, first, last in zip(order.tolist(), begins[order].tolist(), (begins[order] + sizes[order]).tolist()):
        owners.setdefault(raw[first:last], i)
    mine = np.fromiter(owners.values(), np.int64, len(owners))
    texts = list(owners)
    by_anchor = np.argsort(anchors[mine], kind="stable")  # earliest first within an anchor
    ranked = anchors[mine][by_anchor]
    group = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    group_sizes = np.diff(np.append(group, len(ranked)))
    windows = sizes[mine] - length + 1
    stay = np.arange(128)[None, :] < windows[:, None]  # per segment and window; repeats are struck out

    def index(parts: list[list[tuple[int, int, int]]]) -> None:
        """Several groups in one index; windows of different groups are never equal."""
        items = [item for part in parts for item in part]
        data = np.frombuffer(b"".join(texts[t][s : e - 1 + length] for t, s, e in items), np.uint8)
        owner, begin, end = np.array(items, np.int64).T
        whole = end - begin - 1 + length
        starts = np.cumsum(whole) - whole
        skip, end = _again(data, starts, whole, length)
        some = np.flatnonzero(end)
        if not len(some):
            return
        owner, begin, starts, lengths = owner[some], begin[some] + skip[some], starts[some] + skip[some], (end - skip)[some] - 1 + length
        held = RunIndex(data[np.arange(lengths.sum()) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)], lengths)
        at, first = held.first_occurrences(length)
        item = np.searchsorted(held.begins, at, "right") - 1
        gone = ~first
        stay[owner[item[gone]], (begin[item] + at - held.begins[item])[gone]] = False

    pending, waiting = [], 0

    def add(part: list[tuple[int, int, int]], anchor_at: dict[int, int] | None = None) -> None:
        """Take in a group of segments, earliest first, as (segment, first window, end); a large one is divided.

        Windows are divided by how far their anchor lies from their start, and these by the bytes that all windows of such
        a range share: windows in different parts cannot be equal. Parts that say the same become one at each step.
        """
        nonlocal pending, waiting
        if len(part) == 1:
            return
        total = sum(e - 1 + length - s for _, s, e in part)
        if total <= index_bytes:
            pending.append(part)
            waiting += total
            if waiting >= index_bytes:
                index(pending)
                pending, waiting = [], 0
            return
        if anchor_at is None:
            anchor_at = {t: _anchor_place(texts[t], anchors[mine[t]]) for t, _, _ in part}
        near = min(anchor_at[t] - e + 1 for t, s, e in part)
        far = max(anchor_at[t] - s for t, s, e in part)
        if near == far:
            return  # single windows, all different
        middle = (near + far + 1) // 2
        for least, most in ((middle, far), (near, middle - 1)):
            seen: set[bytes] = set()
            parts: dict[bytes, list[tuple[int, int, int]]] = {}
            for t, s, e in part:
                at = anchor_at[t]
                s, e = max(s, at - most), min(e, at - least + 1)
                if s >= e:
                    continue
                text = texts[t][s : e - 1 + length]
                if text in seen:
                    stay[t, s:e] = False
                    continue
                seen.add(text)
                parts.setdefault(texts[t][at - least : at - most + length], []).append((t, s, e))
            for smaller in parts.values():
                add(smaller, anchor_at)

    for first, many in zip(group.tolist(), group_sizes.tolist()):
        if many > 1:
            add([(t, 0, int(windows[t])) for t in by_anchor[first : first + many].tolist()])
    if pending:
        index(pending)
    bits = np.packbits(stay, axis=1, bitorder="little").view(np.uint64)
    low, high = bits[:, 0], bits[:, 1]
    out: dict[str, list] = {"block": [], "ranks": [], "starts": [], "low": [], "high": []}
    by_block = np.argsort(blocks[mine], kind="stable")
    of = blocks[mine][by_block]
    edges = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    for a, b in zip(edges.tolist(), np.append(edges[1:], len(of)).tolist()):
        part = by_block[a:b]
        out["block"].append(int(of[a]))
        out["ranks"].append(ranks[mine[part]].tobytes())
        out["starts"].append(starts[mine[part]].tobytes())
        out["low"].append(low[part].tobytes())
        out["high"].append(high[part].tobytes())
    types = [pa.int32(), *[pa.binary()] * 4]
    return pa.table([pa.array(out[n], t) for n, t in zip(out, types)], list(out))


def _removes(table: pa.Table, answers: pa.Table, length: int) -> pa.Table:
    """Removed spans and remaining bytes of a block's documents."""
    block = Block(table, length)
    anchors = answers.filter(answers.column("low").is_null())
    stays = answers.filter(answers.column("low").is_valid())

    def column(name, kind):
        return np.concatenate([np.zeros(0, kind), *[np.frombuffer(x.as_py(), kind) for x in stays.column(name)]])

    chosen = np.flatnonzero(_repeated(block, anchors))
    first, last = block.first[chosen], block.last[chosen]
    owned = block.at[column("ranks", np.int64)] + column("starts", np.int64)
    order = np.argsort(owned, kind="stable")
    owned, low, high = owned[order], column("low", np.uint64)[order], column("high", np.uint64)[order]
    place = np.searchsorted(owned, first)
    is_owner = np.zeros(len(first), bool)
    if len(owned):
        place = np.minimum(place, len(owned) - 1)
        is_owner = owned[place] == first
    change = np.zeros(len(block.data) + 1, np.int32)
    np.add.at(change, first[~is_owner], 1)
    np.add.at(change, last[~is_owner] + length, -1)
    for begin, end, k in zip(first[is_owner].tolist(), last[is_owner].tolist(), place[is_owner].tolist()):
        kept = int(low[k]) | int(high[k]) << 64
        gone = ~kept & ((1 << (end - begin + 1)) - 1)
        while gone:
            start = (gone & -gone).bit_length() - 1
            run = ~(gone >> start)
            many = (run & -run).bit_length() - 1
            change[begin + start] += 1
            change[begin + start + many - 1 + length] -= 1
            gone &= ~(((1 << many) - 1) << start)
    removed = np.cumsum(change[:-1], dtype=np.int32) > 0
    edges = np.diff(np.concatenate(([0], removed.view(np.int8), [0])))
    at = block.at
    rows, ids, spans, kept_bytes, sizes = [], [], [], [], []
    opens, closes = np.flatnonzero(edges > 0), np.flatnonzero(edges < 0)
    del edges
    raw = block.data.tobytes()
    for k in range(len(block.ids)):
        begin, end = int(at[k]), int(at[k + 1])
        a, b = np.searchsorted(closes, begin, "right"), np.searchsorted(opens, end, "left")
        # A run may go on from text to text; an empty text amid it has no part of it.
        mine = [(max(int(opens[j]), begin) - begin, min(int(closes[j]), end) - begin) for j in range(a, b)] if begin < end else []
        parts, from_ = [], 0
        for x, y in mine:
            parts.append(raw[begin + from_ : begin + x])
            from_ = y
        parts.append(raw[begin + from_ : end])
        whole = end - begin >= length
        for members, gone, left in (
            (block.rows_of[k], [{"start": x, "end": y} for x, y in mine], b"".join(parts)),
            (block.copies_of[k], [{"start": 0, "end": end - begin}] if whole else [], b"" if whole else raw[begin:end]),
        ):
            ids.extend(members)
            spans.extend([gone] * len(members))
            kept_bytes.extend([left] * len(members))
            sizes.extend([end - begin] * len(members))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.table(
        [pa.array(ids, table.schema.field("doc_id").type), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept_bytes, pa.binary())],
        ["doc_id", "n_bytes", "spans", "kept"],
    )


def _sizes(rows: DataFrame, most: int) -> tuple[int, list[int]]:
    """Bytes of all texts, and the hashes of texts whose copies have more than ``most`` bytes in all, each row counted with 64 more."""
    size = F.octet_length("text").cast("bigint")
    texts = rows.groupBy("tie").agg(F.sum(size).alias("size"), F.count("*").alias("copies"))
    heavy = (F.col("copies") > 1) & (F.col("size") + 64 * F.col("copies") > most)
    total, frequent = texts.agg(F.sum("size"), F.collect_list(F.when(heavy, F.col("tie")))).first()
    return int(total or 0), frequent


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, block_bytes=BLOCK_BYTES, bucket_bytes=BUCKET_BYTES, index_bytes=INDEX_BYTES) -> DataFrame:
    """``doc_id``, ``n_bytes``, removed ``spans`` (start, end in bytes) and the ``kept`` bytes of every row.

    ``length`` must be from 24 to 139 bytes, so that a segment has at most 116 windows and 255 bytes.
    """
    if not ANCHOR <= length <= 139:
        raise ValueError("length must be from 24 to 139 bytes")
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    size, frequent = _sizes(rows, block_bytes // 16)
    blocks, buckets = pieces(size, block_bytes), pieces(size, bucket_bytes)
    spread = F.lit(None).cast("bigint")
    if frequent:
        held = docs.sparkSession.createDataFrame([(tie, True) for tie in frequent], "tie bigint, frequent boolean")
        rows = rows.join(F.broadcast(held), "tie", "left")
        spread = F.when(F.col("frequent"), F.col("doc_id"))
    # Copies of a text meet in one block, and none but the first has segments; those of a frequent text go to all blocks.
    number = F.pmod(F.xxhash64(spread, "tie"), F.lit(blocks)).cast("int")
    # All uses of the dealt texts have one plan, so Spark writes this shuffle once.
    dealt = rows.select("doc_id", "tie", "text", number.alias("block")).repartition(max(2, blocks), "block")
    asks = dealt.groupBy("block").applyInArrow(lambda t: _asks(t, buckets, length), "bucket int, block int, keys binary")
    # Small packs would be put into few tasks by their bytes; the work on them is larger, so each bucket has its own.
    shared = asks.repartition(max(2, buckets), "bucket").groupBy("bucket").applyInArrow(_shared_anchors, "block int, keys binary")
    sent = dealt.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(lambda t, a: _sends(t, a, buckets, length), _SENT)
    stay = sent.repartition(max(2, buckets), "bucket").groupBy("bucket").applyInArrow(
        lambda t: _stay(t, length, index_bytes), "block int, ranks binary, starts binary, low binary, high binary"
    )
    answers = stay.withColumn("keys", F.lit(None).cast("binary")).unionByName(shared, allowMissingColumns=True)
    out = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        lambda t, a: _removes(t, a, length), "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"
    )
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))
