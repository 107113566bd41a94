"""Words and their hashes for batches of texts, as whole-buffer numpy steps.

A word is [^\\x20\\x09-\\x0D]+. Its 64-bit hash is a polynomial over the bytes,
taken from running sums, so no word becomes a Python object.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_RNG = np.random.default_rng(20240501)
_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Text bytes handled at once; a longer text is a chunk by itself.
CHUNK = 1 << 18
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    got = _POWERS.get(base)
    if got is None or len(got) < n:
        size = max(n, CHUNK + 1)
        got = np.full(size, base, U64)
        got[0] = 1
        np.cumprod(got, out=got)
        if size <= 4 * CHUNK:
            _POWERS[base] = got
    return got


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64 bits; the constants are those of the public splitmix64."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about limit bytes together."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for k, n in enumerate(lengths):
        if held and held + n > limit:
            yield start, k
            start, held = k, 0
        held += int(n)
    if start < len(lengths):
        yield start, len(lengths)


class Words:
    """Words of a chunk of texts (a string array; nulls count as empty).

    data: bytes; rows: byte offsets of the texts; start, end: byte offsets of the
    words; row: the text each word is in; first: number of the first word of each
    text (one more entry at the end).
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        _, offsets, data = texts.buffers()
        rows = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
        self.data = np.frombuffer(data, np.uint8, rows[-1] - rows[0], rows[0]) if data is not None and rows[-1] > rows[0] else np.zeros(0, np.uint8)
        self.rows = rows - rows[0]
        if lower:
            self.data = _LOWER[self.data]
        self.white = _IS_WHITE[self.data]
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.rows] = True
        solid = ~self.white
        before = np.empty(len(self.data), bool)
        before[:1] = False
        before[1:] = solid[:-1]
        self.start = np.flatnonzero(solid & (~before | edge[:-1]))
        after = np.empty(len(self.data), bool)
        after[-1:] = False
        after[:-1] = solid[1:]
        self.end = np.flatnonzero(solid & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, self.rows)
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(len(self.counts)), self.counts)
        self._sums = None

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges."""
        if self._sums is None:
            self._sums = np.zeros(len(self.data) + 1, U64)
            np.cumsum(_VALUE[self.data] * _powers(_BASE, len(self.data) + 1)[: len(self.data)], out=self._sums[1:])
        own = (self._sums[end] - self._sums[start]) * _powers(_INVERSE, len(self.data) + 1)[start]
        return mix(own + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))

    def word_hashes(self) -> np.ndarray:
        return self.hashes(self.start, self.end)

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a value for each byte over each text."""
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[self.rows[1:]] - sums[self.rows[:-1]]


def sum_by(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of values over the ranges that first delimits."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    flags = np.zeros(len(keys), bool)
    flags[order[1:][same]] = True
    flags[order[:-1][same]] = True
    return flags
