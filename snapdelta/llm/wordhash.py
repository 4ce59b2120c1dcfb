"""Words of many texts at once as 64-bit hashes, by array operations over their UTF-8 bytes.

Words are runs of bytes other than space and tab to carriage return, with A-Z lowered. Both rules concern ASCII only, so
bytes and characters give the same words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_random = np.random.default_rng(20_240_817)
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _random.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEGMENT = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finisher of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and where each begins, with the total last. Nulls have no bytes."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        width = np.int64
    else:
        width = np.int32
    _, ends, data = column.buffers()
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(ends, width, len(column) + 1, column.offset * np.dtype(width).itemsize).astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def portions(batch: pa.RecordBatch, name: str, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``most`` text bytes, at least one row each."""
    _, at = texts_of(batch.column(batch.schema.names.index(name)))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the number of words before each text with the total last."""
    hashes, starts = placed_words(data, at)
    return hashes, np.searchsorted(starts, at, "left")


def placed_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word.

    The bytes are taken in segments that end where a word ends, so temporary arrays stay small for a text of any length.
    """
    byte = _BYTE.copy()
    for capital in range(65, 91):
        byte[capital] = byte[capital + 32]
    gap = np.zeros(256, bool)
    gap[[32, 9, 10, 11, 12, 13]] = True
    byte[gap] = 0
    hashes, starts = [], []
    n, begin = len(data), 0
    while begin < n:
        step = _SEGMENT
        while True:
            end = min(begin + step, n)
            if end == n:
                break
            gaps = np.flatnonzero(gap[data[begin:end]])
            inner = at[np.searchsorted(at, begin, "right") : np.searchsorted(at, end, "right")]
            cut = max(begin + int(gaps[-1]) + 1 if len(gaps) else 0, int(inner[-1]) if len(inner) else 0)
            if cut > begin:
                end = cut
                break
            step *= 2
        part = data[begin:end]
        inside = ~gap[part]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edges = at[np.searchsorted(at, begin, "left") : np.searchsorted(at, end, "left")] - begin
        first[edges] = inside[edges]
        begins = np.flatnonzero(first)
        if len(begins):
            place = np.arange(len(part)) - np.repeat(np.append(0, begins), np.diff(np.concatenate(([0], begins, [len(part)]))))
            values = byte[part] * _PLACE[place & 63]
            far = place >= 64
            if far.any():
                values[far] *= mix((place[far] >> 6).astype(np.uint64)) | np.uint64(1)
            hashes.append(mix(np.add.reduceat(values, begins)))
            starts.append(begins + begin)
        begin = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def factors(random: np.random.Generator) -> np.ndarray:
    """Odd numbers by which the words of a shingle are told apart."""
    return random.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_FACTORS = factors(np.random.default_rng(7_001))


def shingle_set(hashes: np.ndarray, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text's word hashes."""
    if not len(hashes):
        return hashes
    width = min(words, len(hashes))
    mixed = np.zeros(len(hashes) - width + 1, np.uint64)
    for k in range(width):
        mixed += hashes[k : len(hashes) - width + 1 + k] * _FACTORS[k]
    return np.unique(mix(mixed + np.uint64(width)))
