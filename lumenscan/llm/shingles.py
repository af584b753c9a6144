"""Hashed word shingles of whole Arrow columns of text, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.default_rng(20_240_607)
#: A random 64-bit value per byte; A-Z share those of a-z.
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BYTE[65:91] = _BYTE[97:123]
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_BASE, _STEP = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
_powers = np.ones(1, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all."""
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        p = np.full(max(1024, n), _BASE, dtype=np.uint64)
        p[0] = 1
        _powers = np.cumprod(p, dtype=np.uint64)
    return _powers


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word (A-Z lower-cased), and for each text the number of words before it, with the total at the end."""
    col = texts.cast(pa.large_string())
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    if col.null_count:  # a null may have bytes behind it
        col = col.fill_null("")
        offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    offsets = offsets - first
    if last == first:
        return np.empty(0, np.uint64), np.zeros(len(col) + 1, np.int64)
    b = np.frombuffer(col.buffers()[2], np.uint8)[first:last]
    word = _IS_WORD[b]
    before = np.empty_like(word)
    before[0] = False
    before[1:] = word[:-1]
    inner = offsets[:-1]
    before[inner[inner < len(b)]] = False
    starts = np.flatnonzero(word & ~before)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(col) + 1, np.int64)
    at = np.flatnonzero(word)
    first_of = np.searchsorted(at, starts)
    lengths = np.diff(np.append(first_of, len(at)))
    place = np.arange(len(at)) - np.repeat(first_of, lengths)
    h = np.add.reduceat(_BYTE[b[at]] * _power(int(lengths.max()))[place], first_of)
    return mix(h + lengths.astype(np.uint64) * _STEP), np.searchsorted(starts, offsets)


def _combined(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k words in a row."""
    n = len(h) - k + 1
    s = h[:n] * _STEP
    for j in range(1, k):
        s = (s ^ (s >> U(29))) * _BASE + h[j : j + n]
    return mix(s)


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Per text, the sorted distinct hashes of its k-word shingles; a text of fewer words has its whole sequence as one; one of none has none."""
    h, ends = word_hashes(texts)
    all_of = _combined(h, k) if len(h) >= k else np.empty(0, np.uint64)
    for a, e in zip(ends[:-1], ends[1:]):
        if e - a >= k:
            s = np.sort(all_of[a : e - k + 1])
            yield s[np.append(True, s[1:] != s[:-1])]
        elif e > a:
            yield _combined(h[a:e], int(e - a))
        else:
            yield np.empty(0, np.uint64)


class MinHash:
    """Signatures of k coordinates."""

    def __init__(self, coordinates: int):
        r = np.random.default_rng(77)
        self.a = r.integers(1, 2**63, coordinates, dtype=np.uint64) * U(2) + U(1)
        self.b = r.integers(0, 2**63, coordinates, dtype=np.uint64)

    def __call__(self, s: np.ndarray) -> np.ndarray:
        least = None
        for i in range(0, len(s), 4096):
            m = ((s[i : i + 4096, None] * self.a + self.b) >> U(32)).min(0)
            least = m if least is None else np.minimum(least, m)
        return least.astype(np.uint32)
