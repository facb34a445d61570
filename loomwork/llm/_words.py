"""Vectorised word splitting and hashing over the UTF-8 bytes of an Arrow string column.

Both word classes used here are unions of ASCII classes and all of non-ASCII,
so a byte table decides exactly what a code point table would.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: ``[^\x20\x09-\x0D]+``
SPACED = np.ones(256, bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing: digits, letters, all of non-ASCII
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

CHUNK = 1_000_000
_SYMBOL = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 3
_POW = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of SplitMix64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        size = max(n, CHUNK + 1)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POW[k] = np.multiply.accumulate(p)
    return _POW[0], _POW[1]


def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    arr = batch.column(name)
    if arr.null_count:
        arr = arr.fill_null("")
    bufs = arr.buffers()
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    off = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1] if len(arr) else np.zeros(1)
    off = off.astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def chunks(batch: pa.RecordBatch, name: str, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) with at most ``limit`` bytes each, a longer text alone."""
    data, off = column(batch, name)
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


class Words:
    """Words of consecutive texts: ``start``/``end`` bytes, ``first[d]:first[d+1]`` is document d's range."""

    def __init__(self, data: np.ndarray, off: np.ndarray, table: np.ndarray, lower: bool = True):
        self.data = LOWER[data] if lower else data
        self.off = off
        m = table[self.data]
        edge = off[:-1][off[:-1] < off[1:]]
        before = np.zeros(len(m), bool)
        before[1:] = m[:-1]
        before[edge] = False
        self.start = np.flatnonzero(m & ~before)
        after = np.zeros(len(m), bool)
        after[:-1] = m[1:]
        after[edge[1:] - 1] = False
        self.end = np.flatnonzero(m & ~after) + 1
        self.first = np.searchsorted(self.start, off)
        self.count = np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self, *limits: int) -> np.ndarray | list[np.ndarray]:
        """64-bit hash of each word; with ``limits``, a list that also has those of each word's first bytes."""
        spans = (1 << 62, *limits)
        parts: list[list[np.ndarray]] = [[] for _ in spans]
        i, words = 0, len(self.start)
        while i < words or not parts[0]:  # stretches of CHUNK bytes, as prefix sums take many times the text
            j = max(i + 1, int(np.searchsorted(self.end, self.start[i] + CHUNK, "right"))) if words else 0
            at = self.start[i] if words else 0
            data = self.data[at : self.end[j - 1]] if words else self.data[:0]
            start, whole = self.start[i:j] - at, self.end[i:j] - self.start[i:j]
            p, inverse = _powers(len(data) + 1)
            c = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_SYMBOL[data] * p[: len(data)], out=c[1:])
            back = inverse[start]
            for k, limit in enumerate(spans):
                size = np.minimum(whole, limit)
                parts[k].append(mix((c[start + size] - c[start]) * back + size.astype(np.uint64)))
            i = j
        out = [np.concatenate(x) if len(x) != 1 else x[0] for x in parts]
        return out if limits else out[0]


def word_hash(word: bytes) -> int:
    """Hash that ``Words.hashes`` gives to one word."""
    data = np.frombuffer(word, np.uint8)
    return int(Words(data, np.array([0, len(data)]), np.ones(256, bool), False).hashes()[0])
