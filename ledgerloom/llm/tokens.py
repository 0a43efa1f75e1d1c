"""Token ids of whole texts by a file of the tokenizers library, with each distinct chunk of text encoded once.

Both public files that the operators use split their input at white space and marks before any merge, so a text may be cut before
a single space or line feed that stands between two characters that are surely not white space, or between an ASCII
letter or digit and an ASCII mark, and the ids of its
chunks, one after another, are those of the text. Everything else (runs of white space, other white space) stays inside
a chunk. Distinct chunks of a slice come from Arrow's dictionary encoding; a worker keeps those it has met, and when they get too many, those
that it has met in more than one slice.
"""

from __future__ import annotations

import json
import os
from itertools import chain

import numpy as np
import pyarrow as pa

from ledgerloom.llm.columns import buffers

#: Bytes of text that are cut and encoded at once; the most chunks that a worker keeps, some 200 bytes each; chunks that go
#: through the tokenizer at once.
SLICE_BYTES, KEPT, BATCH = 4 << 20, 400_000, 1 << 14

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_LOWER[0x0A] = 0x20
_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = _SOLID[0x80:] = True
#: First bytes of characters among which there is white space outside ASCII: U+0085, U+00A0, U+1680, U+2000 and on, U+3000.
_DOUBT = np.zeros(256, bool)
_DOUBT[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x0A]] = True
_WORD, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x41:0x5B] = _WORD[0x61:0x7B] = True
_MARK[0x21:0x7F] = ~_WORD[0x21:0x7F]
_MARK[0x27] = False  # may begin a contraction


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where chunks begin, and the end of the last; texts begin chunks."""
    n = len(data)
    solid = _SOLID[data]
    at = np.flatnonzero(_DOUBT[data])
    for k in range(3):
        solid[np.minimum(at + k, n - 1)] = False
    found = np.flatnonzero(_GAP[data[1:-1]] & solid[:-2] & solid[2:]) + 1 if n > 2 else np.zeros(0, np.int64)
    if b"<|" not in data.tobytes():  # else a special token might be cut
        found = np.concatenate([found, np.flatnonzero(_WORD[data[:-1]] & _MARK[data[1:]]) + 1])
    flags = np.zeros(n + 1, bool)
    flags[found] = flags[offsets] = flags[0] = flags[n] = True
    return np.flatnonzero(flags)


class Encoder:
    """ids(texts) gives the ids of all the texts, one after another, and how many each has."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # a tokenizer that lowers its input and drops white space has the same ids for these, and fewer chunks
        self.lowers = '"Lowercase"' in json.dumps(json.loads(self.tokenizer.to_str())["normalizer"])
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.begin, self.size, self.uses = (np.zeros(1 << 12, np.int64) for _ in range(3))

    def _make_room(self, wanted: int) -> None:
        """Room for so many more chunks: of those met in more than one slice the most used stay, up to half of all."""
        if len(self.slots) + wanted <= KEPT:
            return
        uses = self.uses[: len(self.slots)]
        kept = np.flatnonzero(uses > 1)
        if len(kept) > KEPT // 2:
            kept = np.sort(kept[np.argsort(-uses[kept], kind="stable")[: KEPT // 2]])
        if not len(kept) or len(kept) + wanted > KEPT:
            self._forget()
            return
        chunks, begin, size = list(self.slots), self.begin[kept], self.size[kept]
        ends = np.cumsum(size)
        self.flat = self.flat[np.repeat(begin - (ends - size), size) + np.arange(ends[-1])]
        self.used, self.begin, self.size, self.uses = len(self.flat), ends - size, size, np.ones(len(kept), np.int64)
        self.slots = {chunks[k]: n for n, k in enumerate(kept.tolist())}

    def _learn(self, chunks: list[str]) -> None:
        done = self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)
        ids = [e.ids for e in done]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        n, k = len(self.slots), int(sizes.sum())
        if self.used + k > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(self.used + 2 * k, np.uint32)])
        if n + len(ids) > len(self.size):
            more = np.zeros(n + 2 * len(ids), np.int64)
            self.begin, self.size, self.uses = (np.concatenate([x[:n], more]) for x in (self.begin, self.size, self.uses))
        self.flat[self.used : self.used + k] = np.fromiter(chain.from_iterable(ids), np.uint32, k)
        self.size[n : n + len(ids)] = sizes
        self.begin[n : n + len(ids)] = self.used + np.cumsum(sizes) - sizes
        self.used += k
        self.slots.update(zip(chunks, range(n, n + len(ids)), strict=True))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = buffers(texts)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        if self.lowers and b"<|" not in data.tobytes():  # special tokens are matched as they stand
            data = _LOWER[data]
        edges = cuts(data, offsets)
        chunks = pa.Array.from_buffers(pa.large_string(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
        coded = chunks.dictionary_encode()
        words = coded.dictionary.to_pylist()
        self._make_room(len(words))
        known = np.array(list(map(self.slots.get, words)), float)  # None becomes nan
        if len(new := np.flatnonzero(np.isnan(known))):
            known[new] = len(self.slots) + np.arange(len(new))
            for k in range(0, len(new), BATCH):
                self._learn([words[x] for x in new[k : k + BATCH].tolist()])
        known = known.astype(np.int64)
        self.uses[known] += 1
        slot = known[coded.indices.to_numpy()]
        size = self.size[slot]
        ends = np.cumsum(size)
        out = self.flat[np.repeat(self.begin[slot] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        upto = np.concatenate([[0], ends])[np.searchsorted(edges, offsets)]
        return out, np.diff(upto)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with `end` after each document's, and the bounds of the documents."""
    bounds = np.concatenate([[0], np.cumsum(counts)])
    return np.insert(ids, bounds[1:], np.uint32(end)), bounds + np.arange(len(bounds))


def binary(parts: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column of runs of 32-bit ids, little-endian; bounds in ids."""
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * 4).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(parts.astype("<u4")))])
