"""Vectorised tokenising of Arrow text columns.

A text column arrives as one buffer of UTF-8 bytes with offsets. Words are runs of word bytes; their
64-bit hashes come from one cumulative sum over the bytes of a chunk (a polynomial hash modulo 2**64),
so there is no Python object per word. Chunks bound the memory of a pass; a text is never split or cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one numpy pass works on (a longer single text makes a pass of its own).
CHUNK_BYTES = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_GRAM = np.uint64(0xD1342543DE82EF95)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_MIX2 = np.uint64(0xC4CEB9FE1A85EC53)
_powers: dict[str, np.ndarray] = {}

#: Byte maps: the lower-cased byte (A-Z only), and whether the byte belongs to a word.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD_ALNUM = np.zeros(256, bool)  # [0-9A-Za-z] and everything outside ASCII
WORD_ALNUM[48:58] = WORD_ALNUM[65:91] = WORD_ALNUM[97:123] = WORD_ALNUM[128:] = True
WORD_NOT_SPACE = np.ones(256, bool)  # all but space and \x09-\x0D
WORD_NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX
    h ^= h >> np.uint64(29)
    h *= _MIX2
    h ^= h >> np.uint64(32)
    return h


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK_BYTES + 4096), base, np.uint64)
        steps[0] = 1
        have = _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """Cumulative polynomial hash of bytes; :func:`span_hashes` reads any span from it."""
    c = np.empty(len(values) + 1, np.uint64)
    c[0] = 0
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, len(values)), out=c[1:])
    return c


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte spans; equal content gives equal hashes wherever it stands."""
    return mix((prefix[ends] - prefix[starts]) * _power("down", _BASE_INVERSE, len(prefix))[starts])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), off


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each, one row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


@dataclass
class Words:
    """Words of some rows: hashes in text order; words of row i are ``ptr[i]:ptr[i + 1]``."""

    hashes: np.ndarray
    ptr: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.ptr)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), self.counts)


def words(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray, hashed: bool = True) -> Words:
    """Split the rows between ``offsets`` into lower-cased words of ``word_bytes``."""
    base = offsets[0]
    part = LOWER[data[base : offsets[-1]]]
    bounds = (offsets - base).astype(np.int64)
    inside = word_bytes[part]
    edge = np.zeros(len(part) + 1, bool)  # a row begins here: no word goes across
    edge[bounds] = True
    first, last = inside.copy(), inside.copy()
    if len(part):
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    h = span_hashes(prefix_hashes(part), starts, ends) if hashed else np.zeros(0, np.uint64)
    return Words(h, np.searchsorted(starts, bounds), starts, ends, part)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive words, rows not regarded (see :func:`gram_rows`)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = h[:n].copy()
    for j in range(1, k):
        g *= _GRAM
        g += h[j : j + n]
    return mix(g)


def gram_rows(w: Words, k: int) -> np.ndarray:
    """For each result of ``grams``, the row that holds the whole run, or -1 where it crosses rows."""
    n = len(w.hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    row = w.row
    return np.where(row[:n] == row[k - 1 :], row[:n], -1)
