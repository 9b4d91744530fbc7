"""Whole texts of an Arrow batch as flat numpy arrays: words, lines and their hashes.

Words are runs of bytes other than ASCII white space (``[^\\x20\\x09-\\x0D]+``),
which on UTF-8 bytes is the same as on code points. Every hash is a 64-bit
polynomial over a fixed random byte table, taken for all words of a batch with
one cumulative sum; two different words or lines share a hash with a
probability of about 2**-58.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2_000_000
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_ORDER = [0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0x27D4EB2F165667C5]

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _TABLE.copy()
_LOWER[65:91] = _LOWER[97:123]


@lru_cache(maxsize=4)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done:done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
        done += more
    return out


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    size = 1 << max(12, (n - 1).bit_length())
    return _powers(size, base)[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (returns a new array)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text (one row at least)."""
    texts = as_large(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        to = min(to, len(texts))
        yield at, to
        at = to


def as_large(texts) -> pa.Array:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts


class TextBatch:
    """Words of the rows ``[lo, hi)`` of a string array; a null text has none."""

    def __init__(self, texts, lo: int = 0, hi: int | None = None):
        texts = as_large(texts)
        hi = len(texts) if hi is None else hi
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset + lo:texts.offset + hi + 1]
        base, end = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
        data = texts.buffers()[2]
        self.bytes = np.frombuffer(data, np.uint8)[base:end] if data is not None and end > base else np.empty(0, np.uint8)
        self.doc_at = offsets - base
        self.n_docs = hi - lo
        solid = ~IS_SPACE[self.bytes]
        n = len(solid)
        edge = np.zeros(n + 1, bool)  # a text begins (or the batch ends) here
        edge[self.doc_at] = True
        self.edge = edge
        before = np.empty(n, bool)
        if n:
            before[0] = False
            before[1:] = solid[:-1]
            before &= ~edge[:-1]
        self.start = np.flatnonzero(solid & ~before)
        after = np.empty(n, bool)
        if n:
            after[-1] = False
            after[:-1] = solid[1:]
            after &= ~edge[1:]
        self.end = np.flatnonzero(solid & ~after) + 1
        self.solid = solid
        #: word index at which each text begins; one entry more than texts
        self.word_at = np.searchsorted(self.start, self.doc_at)
        self.n_words = np.diff(self.word_at)
        self.doc = np.repeat(np.arange(self.n_docs), self.n_words)

    def span_hashes(self, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
        """Hashes of the byte spans; with ``lower``, A-Z count as a-z."""
        if not len(start):
            return np.empty(0, np.uint64)
        n = len(self.bytes)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum((_LOWER if lower else _TABLE)[self.bytes] * powers(n, _P), out=total[1:])
        return mix64((total[end] - total[start]) * powers(n, _P_INV)[start] + (end - start).astype(np.uint64))

    def word_hashes(self, lower: bool) -> np.ndarray:
        return self.span_hashes(self.start, self.end, lower)

    def windows(self, words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first word index of each window of ``size`` words inside one text."""
        n = len(words) - size + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        at = np.flatnonzero(self.doc[:n] == self.doc[size - 1:])
        acc = np.zeros(n, np.uint64)
        for k in range(size):
            acc = (acc ^ words[k:k + n]) * np.uint64(_ORDER[k % 5])
            acc ^= acc >> np.uint64(32)
        return acc[at], at

    def per_doc(self, doc: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        """Counts (or sums) by document."""
        return np.bincount(doc, weights=weights, minlength=self.n_docs).astype(np.int64)

    def bytes_per_doc(self, mark: np.ndarray) -> np.ndarray:
        """Marked bytes in each text."""
        total = np.concatenate(([0], np.cumsum(mark, dtype=np.int64)))
        return np.diff(total[self.doc_at])


def shingle_sets(batch: TextBatch, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word shingles of each text: (text index, hash), sorted by both.

    Words are lower-cased in A-Z; a text with fewer words than ``size`` is one
    shingle, a text without words has none.
    """
    words = batch.word_hashes(lower=True)
    h, at = batch.windows(words, size)
    doc = batch.doc[at]
    short = np.flatnonzero((batch.n_words > 0) & (batch.n_words < size))
    if len(short):
        extra = np.empty(len(short), np.uint64)
        for i, d in enumerate(short):
            acc = np.uint64(int(batch.n_words[d]))
            for w in words[batch.word_at[d]:batch.word_at[d + 1]]:
                acc = mix64(np.array([acc], np.uint64) * np.uint64(_ORDER[0]) ^ w)[0]
            extra[i] = acc
        h, doc = np.concatenate([h, extra]), np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        h, doc = h[order], doc[order]
    ends = np.searchsorted(doc, np.arange(batch.n_docs + 1))
    h = h.copy()
    for a, b in zip(ends[:-1], ends[1:]):
        h[a:b].sort()
    if len(h):
        new = np.empty(len(h), bool)
        new[0] = True
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[new], doc[new]
    return doc, h
