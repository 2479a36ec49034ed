"""Vectorised text kernels on Arrow buffers: words, word hashes and shingles of many documents at once.

A word is a maximal run of bytes other than space and 0x09-0x0D. Those delimiters are ASCII, so working on
UTF-8 bytes gives the words of ``[^\\x20\\x09-\\x0D]+`` exactly. Null texts count as empty.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_P, _Q = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
_P_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_CODE = np.random.RandomState(7).randint(1, 1 << 62, 256, dtype=np.int64).astype(np.uint64) * _U(2) + _U(1)
_LOWER = _CODE.copy()
_LOWER[65:91] = _CODE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


_held: dict[str, object] = {}


def held(owner: str, make):
    """What ``make`` builds, kept between a worker's tasks. Workers serve one operator after another, so only the last
    owner's tables are kept."""
    if owner not in _held:
        if _held:
            _held.clear()
            gc.collect()
        _held[owner] = make()
    return _held[owner]


class Places:
    """Places of distinct 64-bit keys, numbered as they come, in sorted arrays: 12 bytes a key, of which a dict takes a
    hundred."""

    def __init__(self) -> None:
        self.key, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def __len__(self) -> int:
        return len(self.key)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The keys' places, -1 where unknown."""
        if not len(self.key):
            return np.full(len(keys), -1, np.int64)
        k = np.minimum(np.searchsorted(self.key, keys), len(self.key) - 1)
        return np.where(self.key[k] == keys, self.at[k], -1).astype(np.int64)

    def add(self, keys: np.ndarray) -> None:
        """Give ``keys``, ascending and all unknown, the next places."""
        k, n = np.searchsorted(self.key, keys), len(self.key)
        self.key, self.at = np.insert(self.key, k, keys), np.insert(self.at, k, np.arange(n, n + len(keys), dtype=np.int32))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, p in enumerate((_P, _P_INV)):
            x = np.full(n, p, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=np.uint64)
    return _powers


def blocks(column: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of documents of about ``most`` bytes (a longer document is a run of its
    own): first row, end row, the bytes, and the documents' offsets in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield first, end, raw[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


def prefixes(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """Polynomial sums of all prefixes of ``data``, for ``span_hashes``; with ``lower``, A-Z counts as a-z."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER if lower else _CODE)[data] * _power(len(data) + 1)[0][: len(data)], out=total[1:])
    return total


def span_hashes(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from ``start`` to ``end``: equal bytes have equal hashes, wherever they stand."""
    return mix((total[end] - total[start]) * _power(len(total))[1][start] + (end - start).astype(np.uint64) * _Q)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all documents' words: start byte, end byte, and each document's first word (one more entry than documents)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, solid[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, solid[1:]
    ends = offsets[1:]
    after[ends[ends > 0] - 1] = False
    start = np.flatnonzero(solid & ~before)
    return start, np.flatnonzero(solid & ~after) + 1, np.searchsorted(start, offsets)


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``word_spans`` with the words' hashes (A-Z as a-z if ``lower``) before the last."""
    start, end, first = word_spans(data, offsets)
    return start, end, span_hashes(prefixes(data, lower), start, end), first


def grams(hashed: np.ndarray, first: np.ndarray, n: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``n``-word shingles, document after document, and each document's first one. With ``short``,
    a document of fewer words has its whole word sequence as one shingle."""
    count = np.diff(first)
    total = len(hashed)
    if total >= n:
        s = np.zeros(total - n + 1, np.uint64)
        for k in range(n):
            s = s * _Q + hashed[k : total - n + 1 + k]
        s = mix(s + _U(n))
    else:
        s = np.zeros(0, np.uint64)
    each = np.maximum(count - n + 1, 0)
    if short:
        each = np.where((count > 0) & (count < n), 1, each)
    at = np.concatenate(([0], np.cumsum(each)))
    out = np.empty(at[-1], np.uint64)
    full = count >= n
    if full.any():
        word = np.arange(total)
        room = np.repeat(first[1:], count) - word  # words from here to the document's end
        ok = room >= n
        where = np.repeat(at[:-1] - first[:-1], count)[ok] + word[ok]
        out[where] = s[word[ok]]
    if short:
        few = np.flatnonzero((count > 0) & (count < n))
        x = np.zeros(len(few), np.uint64)
        for k in range(n - 1):
            more = count[few] > k
            x[more] = x[more] * _Q + hashed[first[few[more]] + k]
        out[at[few]] = mix(x + count[few].astype(np.uint64))
    return out, at
