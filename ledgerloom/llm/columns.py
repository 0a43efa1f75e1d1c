"""Vectorised work on columns of text: words and their hashes straight from Arrow's buffers.

Python never sees single words here. A batch of texts is one byte buffer with offsets; word bounds come from a
lookup table over bytes, and 64-bit word hashes from prefix sums of a polynomial over the buffer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ledgerloom.shipping import trim

#: Bytes of text that are worked on at once; per-byte temporaries take about 40 times that.
SLICE_BYTES = 512 << 10

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of words that white space ends, and of words of digits, lower-case letters and everything outside ASCII.
NOT_SPACE = ~_SPACE
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 2**64)
_pow = {"n": 0, "p": None, "q": None}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _pow["n"] < n:
        n = max(n, SLICE_BYTES + 1)
        p, q = np.full(n, _P, np.uint64), np.full(n, _PINV, np.uint64)
        p[0] = q[0] = 1
        _pow.update(n=n, p=np.multiply.accumulate(p), q=np.multiply.accumulate(q))
    return _pow["p"], _pow["q"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in order, in slices of at most `limit` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = buffers(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end
    trim()


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts and, from 0, where each begins and the last ends. Null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("" if not pa.types.is_binary(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offs, data = texts.buffers()
    if offs is None or len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words of a slice of texts: `starts` and `ends` in `data`, and `first[d]:first[d+1]` are those of text d."""

    def __init__(self, texts: pa.Array, kind: np.ndarray, lower: bool = True):
        data, self.offsets = buffers(texts)
        self.data = _LOWER[data] if lower else data
        inside = kind[self.data]
        n = len(inside)
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        if n:
            before[1:], after[:-1] = inside[:-1], inside[1:]
            edges = self.offsets[self.offsets < n]
            before[edges] = False
            ends = self.offsets[self.offsets > 0] - 1
            after[ends] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.n = len(texts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(self.n), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word; the same word has the same hash in every slice."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        p, q = _powers(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * p[: len(self.data)], out=sums[1:])
        h = (sums[self.ends] - sums[self.starts]) * q[self.starts]
        return mix(h + (self.ends - self.starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def ngrams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words and their first words' places; none crosses from one text to the next."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    acc = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        acc = acc * np.uint64(0xD1342543DE82EF95) + h[k : len(h) - n + 1 + k]
    last = np.repeat(first[1:], np.diff(first))[: len(acc)]
    at = np.flatnonzero(np.arange(len(acc)) + n <= last)
    return mix(acc[at]), at


def ngram_key(h: np.ndarray) -> np.uint64:
    """The hash that ngrams() gives a run of all these words."""
    return ngrams(h, np.array([0, len(h)]), len(h))[0][0]


def code_points(data: np.ndarray) -> np.ndarray:
    """For each byte place, and the end, how many code points begin before it."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
