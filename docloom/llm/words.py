"""Words of whole Arrow text columns as 64-bit hashes, all words of a batch at once.

A word is a run of bytes other than 0x20 and 0x09-0x0D; letters A-Z may count as lower case. Words of up to ``SHORT`` bytes
have a polynomial hash over random values of their bytes, read off running sums over the buffer; longer ones, rare in
text, are hashed one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_ALL = (1 << 64) - 1
K1, K2, K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
SHORT, BLOCK = 64, 1 << 16
#: Bytes of text that are hashed at once, unless one text is longer.
MOST_BYTES = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * K2
    x = (x ^ (x >> np.uint64(27))) * K3
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out, x = np.empty(n, np.uint64), 1
    for i in range(n):
        out[i] = x
        x = x * base & _ALL
    return out


_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_EXACT = np.random.default_rng(1618).integers(0, 1 << 64, 256, np.uint64)
_FOLDED = _EXACT.copy()
_FOLDED[65:91] = _FOLDED[97:123]
_BASE = 0xD1342543DE82EF95
_UP, _DOWN = _powers(_BASE, BLOCK + SHORT), _powers(pow(_BASE, -1, 1 << 64), BLOCK)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings without nulls, and where each text starts, the end last."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    if buffers[2] is None or not len(column):
        return np.zeros(0, np.uint8), offsets - offsets[0]
    size = int(offsets[-1] - offsets[0])
    return np.frombuffer(buffers[2], np.uint8, size, int(offsets[0])), offsets - offsets[0]


def parts(column: pa.Array, most: int = MOST_BYTES):
    """(first, slice) parts of a column of some ``most`` bytes each, so that memory follows that and the longest text."""
    if not len(column):
        return
    ends = text_bytes(column)[1][1:]
    at = 0
    while at < len(column):
        floor = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, floor + most, "right")))
        yield at, column.slice(at, to - at)
        at = to


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of every word, and each text's first word with the number of all words last."""
    ink = ~_GAP[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.concatenate([[False], ink[:-1]]) if len(data) else ink
    starts = np.flatnonzero(ink & (~before | cut[:-1]))
    after = np.concatenate([ink[1:], [False]]) if len(data) else ink
    ends = np.flatnonzero(ink & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, folds: bool = True) -> np.ndarray:
    """A 64-bit hash of each word; if it ``folds``, letters A-Z count as lower case."""
    values = _FOLDED if folds else _EXACT
    out = np.empty(len(starts), np.uint64)
    bounds = np.searchsorted(starts, np.arange(0, len(data) + BLOCK, BLOCK))
    for k in range(len(bounds) - 1):
        lo, hi = bounds[k], bounds[k + 1]
        if lo == hi:
            continue
        seg = data[k * BLOCK : (k + 1) * BLOCK + SHORT]
        sums = np.empty(len(seg) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(values[seg] * _UP[: len(seg)], out=sums[1:])
        s = starts[lo:hi] - k * BLOCK
        e = np.minimum(ends[lo:hi] - k * BLOCK, len(seg))
        out[lo:hi] = (sums[e] - sums[s]) * _DOWN[s]
    size = ends - starts
    out = mix(out ^ (size.astype(np.uint64) * K1))
    for i in np.flatnonzero(size > SHORT).tolist():
        import xxhash

        word = data[starts[i] : ends[i]].tobytes()
        out[i] = xxhash.xxh3_64_intdigest(word.lower() if folds else word)
    return out


def hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of a column, and each text's first, the number of all last."""
    data, offsets = text_bytes(column)
    starts, ends, first = word_places(data, offsets)
    return word_hashes(data, starts, ends), first


class HashTable:
    """Numbers by 64-bit hashes other than 0, found for many hashes at once."""

    def __init__(self, bits: int):
        self.shift = np.uint64(64 - bits)
        self.last = (1 << bits) - 1
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's number, -1 where there is none."""
        out = np.full(len(keys), -1, np.int64)
        slot, left = (keys >> self.shift).astype(np.int64), np.arange(len(keys))
        while len(left):
            there = self.keys[slot]
            hit = there == keys[left]
            out[left[hit]] = self.values[slot[hit]]
            on = ~hit & (there != 0)
            left, slot = left[on], (slot[on] + 1) & self.last
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds keys, which are new and distinct; at least as many slots must be free."""
        slot, left = (keys >> self.shift).astype(np.int64), np.arange(len(keys))
        while len(left):
            free = np.flatnonzero(self.keys[slot] == 0)
            self.keys[slot[free]] = keys[left[free]]  # of several for one slot the last stays
            there = self.keys[slot] == keys[left]
            self.values[slot[there]] = values[left[there]]
            left, slot = left[~there], (slot[~there] + 1) & self.last


def grams(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of ``width`` words."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = np.full(n, width, np.uint64)
    for i in range(width):
        x = mix(x * K1 + h[i : i + n])
    return x


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """Each text's sorted distinct hashes of runs of ``width`` words; of a text with fewer, of all its words."""
    h, first = hashed(column)
    every = grams(h, width)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        s = every[a : b - width + 1] if b - a >= width else grams(h[a:b], b - a) if b > a else every[:0]
        s = np.sort(s)
        out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) > 1 else s)
    return out
