"""Vectorised 64-bit hashes of words, n-grams and prefixes, straight from the UTF-8 buffers of Arrow batches.

A word is a run of ASCII letters and digits or of characters outside ASCII. Callers lower-case texts in the JVM first.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_P = 0x9E3779B97F4A7C15 | 1
_LUT = np.zeros(256, np.uint8)
for _c in range(256):
    if _c >= 128 or chr(_c).isalnum():
        _LUT[_c] = ord(chr(_c).lower()) if _c < 128 else _c
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Bytes of text that are hashed at once.
PIECE = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every bit of h over all 64."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0..n of the base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) <= n:
        size = max(n + 1, PIECE + 1)
        for k, base in enumerate((_P, pow(_P, -1, 1 << 64))):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _POWERS[k] = np.multiply.accumulate(out)
    return _POWERS[0], _POWERS[1]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its offsets (nulls count as empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, off, data = texts.buffers()
    if len(texts) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    off = np.frombuffer(off, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def give_back() -> None:
    """Return memory that a task no longer needs to the system: Python workers live on beside those of later stages."""
    for k in (0, 1):
        _POWERS[k] = np.ones(1, np.uint64)
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


class Words:
    """The words of a run of texts: full hashes, start and end bytes, and the index of each text's first word."""

    def __init__(self, hashes, first, cum, start, end, ipow):
        self.hashes, self.first, self._cum, self._start, self._end, self._ipow = hashes, first, cum, start, end, ipow

    def of(self, at: np.ndarray) -> Words:
        """Those of these indexes, as if of no text."""
        return Words(self.hashes[at], None, self._cum, self._start[at], self._end[at], self._ipow)

    def prefix(self, k: int) -> np.ndarray:
        """Hashes of the first k bytes of every word (the whole word, if it is shorter)."""
        end = np.minimum(self._start + k, self._end)
        with np.errstate(over="ignore"):
            return mix((self._cum[end] - self._cum[self._start]) * self._ipow[self._start] + np.uint64(k * 0x632BE5AB))


def words(data: np.ndarray, off: np.ndarray) -> Words:
    """Hash the words of the texts data[off[i]:off[i+1]]."""
    n = len(data)
    power, ipow = _powers(n)
    x = _LUT[data]
    inside = x != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cuts = off[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    begins[cuts] |= inside[cuts]
    ends[cuts - 1] |= inside[cuts - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    with np.errstate(over="ignore"):
        cum = np.zeros(n + 1, np.uint64)
        np.cumsum(x * power[:n], out=cum[1:])
        h = mix((cum[end] - cum[start]) * ipow[start])
    return Words(h, np.searchsorted(start, off), cum, start, end, ipow)


def pieces(off: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of texts of at most so many bytes together; a longer text is a run of its own."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def ngrams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams of each text and the index of each text's first; a text of fewer words than n has one n-gram, of all its words."""
    count = np.diff(first)
    out_count = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    out_first = np.concatenate([[0], np.cumsum(out_count)])
    with np.errstate(over="ignore"):
        if len(h) >= n:
            g = np.zeros(len(h) - n + 1, np.uint64)
            for k in range(n):
                g = g * np.uint64(0xD6E8FEB86659FD93) + h[k : len(h) - n + 1 + k]
        else:
            g = np.zeros(0, np.uint64)
        # keep the starts whose n words lie in one text
        pos = np.arange(int(out_first[-1])) - np.repeat(out_first[:-1], out_count) + np.repeat(first[:-1], out_count)
        out = np.zeros(len(pos), np.uint64)
        short = np.repeat(count < n, out_count)
        out[~short] = g[pos[~short]]
        for i in np.flatnonzero((count > 0) & (count < n)):
            v = np.uint64(int(count[i]) + 77)
            for w in h[first[i] : first[i + 1]]:
                v = v * np.uint64(0xD6E8FEB86659FD93) + w
            out[out_first[i]] = v
    return mix(out), out_first
