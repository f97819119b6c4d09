"""Words, shingles and anchors of many documents at once, as numpy arrays over Arrow buffers.

A document's words are the maximal runs of bytes other than space and \\t..\\r. Hashes are
polynomials modulo 2**64 over a random table of byte values, read off one prefix sum, then mixed.
Work is done on slices of a few MB, so memory follows the longest document, not the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE_BYTES = 1 << 20
_BASE, _STEP = 0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=4)
def _values(lower: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
    if lower:
        values = values.copy()
        values[65:91] = values[97:123]
    return values


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, U(b), U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = (out[0], out[1])
        if n <= SLICE_BYTES * 2:
            _powers[base] = have
    return have


@dataclass
class Words:
    """Words of documents first..first+n_docs-1 of a batch."""

    first: int
    n_docs: int
    data: np.ndarray  # bytes
    offsets: np.ndarray  # of documents in data
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray  # of documents in the words: document i has words bounds[i]..bounds[i+1]

    def hashes(self, lower: bool = False) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, U)
        up, down = powers(_BASE, len(self.data))
        prefix = np.zeros(len(self.data) + 1, U)
        np.cumsum(_values(lower)[self.data] * up[: len(self.data)], out=prefix[1:])
        return mix((prefix[self.ends] - prefix[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(U))

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), np.diff(self.bounds))

    def left(self) -> np.ndarray:
        """For each word, how many words its document has from it on."""
        return np.repeat(self.bounds[1:], np.diff(self.bounds)) - np.arange(len(self.starts))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on; the last k-1 places hold zero."""
    n = len(hashes)
    out = np.zeros(n, U)
    if n >= k:
        up, down = powers(_STEP, n)
        prefix = np.zeros(n + 1, U)
        np.cumsum(hashes * up[:n], out=prefix[1:])
        out[: n - k + 1] = mix((prefix[k:] - prefix[: n - k + 1]) * down[: n - k + 1])
    return out


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and 64-bit offsets of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):
    _trim = lambda _: 0


def release() -> None:
    """Give memory that is free back to the system: workers are kept and share an executor's limit."""
    pa.default_memory_pool().release_unused()
    _trim(0)


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, documents, bytes, offsets) of runs of documents with about `most` bytes."""
    data, offsets = buffers(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j - i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
    release()


def split(data: np.ndarray, offsets: np.ndarray, first: int = 0) -> Words:
    n_docs = len(offsets) - 1
    solid = ~_SPACE[data]
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begin[inner] |= solid[inner]
    end[inner - 1] |= solid[inner - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return Words(first, n_docs, data, offsets, starts, ends, np.searchsorted(starts, offsets))


def words(column: pa.Array) -> Iterator[Words]:
    for first, _, data, offsets in slices(column):
        yield split(data, offsets, first)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """out[i] = min(x[i:i+width]), for the len(x)-width+1 whole windows."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(w: Words, hashes: np.ndarray, k: int, window: int) -> tuple[np.ndarray, ...]:
    """Minimisers: runs of windows (of `window` words) whose least k-word hash stands at one place.

    Equal windows have their anchor at the same place, so all places of a repeated window meet under
    one hash. Returns (hash at the anchor, document, first window, last window, place of the anchor),
    places counted in words from the document's first.
    """
    none = (np.zeros(0, U), *[np.zeros(0, np.int64)] * 4)
    n = len(hashes)
    if n < window:
        return none
    g, left = grams(hashes, k), w.left()
    key = (g & U(0xFFFFFFFF00000000)) | np.arange(n, dtype=U)
    key[left < k] = U(0xFFFFFFFFFFFFFFFF)
    at = (sliding_min(key, window - k + 1) & U(0xFFFFFFFF)).astype(np.int64)
    good = np.flatnonzero(left[: len(at)] >= window)
    if not len(good):
        return none
    at = at[good]
    fresh = np.ones(len(good), bool)
    fresh[1:] = (at[1:] != at[:-1]) | (good[1:] != good[:-1] + 1)
    lo = np.flatnonzero(fresh)
    hi = np.append(lo[1:], len(good)) - 1
    doc = np.searchsorted(w.bounds, at[lo], side="right") - 1
    begin = w.bounds[doc]
    return g[at[lo]], doc, good[lo] - begin, good[hi] - begin, at[lo] - begin


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
