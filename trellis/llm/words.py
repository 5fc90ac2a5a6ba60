"""Vectorised words and rolling hashes over Arrow text columns.

A word is ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 bytes; words never cross documents.  All hashes are 64-bit polynomial
prefix hashes passed through a finalizer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_BYTE = np.random.Generator(np.random.PCG64(20240601)).integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for later calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, U64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (bijective)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def flatten(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and its n+1 offsets; null is empty."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], pa.large_binary())
    if arr.type != pa.large_binary():
        arr = arr.cast(pa.binary()).cast(pa.large_binary()) if pa.types.is_string(arr.type) else arr.cast(pa.large_binary())
    if arr.null_count:
        arr = pc.fill_null(arr, b"")
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(arr.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes; a longer document stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """Words of a run of documents: byte spans, document of each, first word of each document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        n = len(data)
        solid = ~_SPACE[data]
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        before = np.empty(n, bool)
        if n:
            before[0] = True
            before[1:] = ~solid[:-1]
        self.starts = np.flatnonzero(solid & (before | first[:n]))
        after = np.empty(n, bool)
        if n:
            after[-1] = True
            after[:-1] = ~solid[1:]
        self.ends = np.flatnonzero(solid & (after | first[1:])) + 1
        self.at = np.searchsorted(self.starts, offsets).astype(np.int64)
        self.count = np.diff(self.at)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.count)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word; ``lower`` folds A-Z first."""
        data = self.data
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        out = np.empty(len(self.starts), U64)
        i = 0
        while i < len(out):  # a run at a time, so that the prefix sums stay in the cache
            low = int(self.starts[i])
            j = max(i + 1, int(np.searchsorted(self.starts, low + (1 << 18))))
            part = data[low : int(self.ends[j - 1])]
            sums = np.zeros(len(part) + 1, U64)
            np.cumsum(_BYTE[part] * powers(_BASE, len(part)), out=sums[1:])
            begin, end = self.starts[i:j] - low, self.ends[i:j] - low
            out[i:j] = mix((sums[end] - sums[begin]) * powers(inverse(_BASE), len(part) + 1)[begin] + (end - begin).astype(U64))
            i = j
        return out

    def grams(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of ``size`` words inside one document."""
        n = len(hashes)
        if n < size:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        inside = np.arange(n - size + 1)
        inside = inside[inside + size <= self.at[1:][self.doc[: n - size + 1]]]
        sums = np.zeros(n + 1, U64)
        np.cumsum(hashes * powers(_WORD_BASE, n), out=sums[1:])
        return inside, mix((sums[inside + size] - sums[inside]) * powers(inverse(_WORD_BASE), n + 1)[inside])


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    if not len(keys):
        return np.zeros(0, bool)
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    return twice


def packed(*columns: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(c).tobytes() for c in columns)
