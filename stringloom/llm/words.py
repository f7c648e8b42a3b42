"""Words of whole texts as arrays: positions and 64-bit hashes, for a batch of texts at once.

A-Z is lower-cased and words are runs of anything but ASCII white space. A word's hash is a polynomial in its bytes, read off prefix
sums (all arithmetic modulo 2**64) and then mixed; the hash of a word's first k bytes is read off the same sums.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; a longer text is worked on alone.
SLICE_BYTES = 1_000_000
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_power = _inverse = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _power, _inverse
    if len(_power) < n:
        size = max(n, SLICE_BYTES + 1)
        back = pow(_BASE, -1, 2**64)
        _power, _inverse = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (_BASE, back))
    return _power, _inverse


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have at most `most` bytes, or one row."""
    if not len(texts):
        return
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(size)
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


class Words:
    """starts and ends (bytes into data), doc (index of the text), first (index of each text's first word, one more entry), hash."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts, "") if texts.null_count else texts
        wide = pa.types.is_large_string(texts.type)
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
        at -= at[0]
        self.n, self.text_start = len(texts), at
        self.data = data = _LOWER[raw]
        n = len(data)
        space = np.ones(n + 1, bool)
        space[:n] = _SPACE[data]
        begin = ~space[:n]
        edge = np.zeros(n + 1, bool)
        edge[at] = True
        # a word starts where no white space follows white space or a text's start
        before = np.empty(n, bool)
        if n:
            before[0] = True
            before[1:] = space[: n - 1]
        self.starts = np.flatnonzero(begin & (before | edge[:n]))
        self.ends = np.flatnonzero(begin & (space[1 : n + 1] | edge[1 : n + 1])) + 1
        self.doc = (np.searchsorted(at[1:], self.starts, "right")).astype(np.int64)
        self.first = np.searchsorted(self.doc, np.arange(self.n + 1))
        power, self._inverse = _powers(n + 1)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=self._sums[1:])
        self.hash = self.part(self.starts, self.ends)

    def part(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the byte ranges; equal bytes, equal hash."""
        return mix((self._sums[ends] - self._sums[starts]) * self._inverse[starts])

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every run of k words within a text."""
        if len(self.hash) < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        same = np.flatnonzero(self.doc[: len(self.doc) - k + 1] == self.doc[k - 1 :])
        return same, mix(run_hash(self.hash, k)[same])

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def run_hash(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive hashes, in order-sensitive form."""
    n = len(hashes) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[i : i + n]
    return out
