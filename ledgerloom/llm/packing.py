"""Packing of tokenised documents into training sequences, balanced by the cost of attention.

Every task packs the documents of its own input split, block by block, so nothing is shuffled and memory is bounded by
one block, which ends at `block_tokens` ids or `block_docs` documents. Whole runs of `capacity` ids of a long document are sequences of their own. What is left of each document is
assigned, longest first, to the sequence of lowest estimated cost (linear * n + quadratic * n * n for each document of
n ids in it) that still has room for the whole of it. A block has as few sequences as its ids allow; what fits nowhere
whole is cut into the gaps that remain, the largest first. The ids beyond the last full sequence go to sequences of a
power of two, so a block's padding stays under `grain` ids.

Null texts are empty: such a document is the end id alone. Null or repeated doc_ids are packed as rows of their own;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ledgerloom.llm.columns import text_slices
from ledgerloom.llm.tokens import SLICE_BYTES, encoder, with_end
from ledgerloom.shipping import ship, trim

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def assign(lengths: np.ndarray, capacity: int, linear: float = 1.0, quadratic: float | None = None, grain: int = 128) -> list[tuple[int, int, int, int, int]]:
    """Packs documents of under `capacity` ids. Returns pieces (document, start, length, sequence, offset).

    quadratic: by default that at which both terms are equal for a full sequence."""
    quadratic = linear / capacity if quadratic is None else quadratic
    total = int(lengths.sum())
    if not total:
        return []
    order = np.argsort(-lengths, kind="stable")
    left = [(int(lengths[d]), int(d), 0) for d in order]
    pieces: list[tuple[int, int, int, int, int]] = []
    full, rest = divmod(total, capacity)
    rest = -(-rest // grain) * grain
    sequence = 0
    size = capacity // 2
    while size >= grain and rest:  # the ids beyond the full sequences
        if rest & size:
            k = next((k for k in range(len(left) - 1, -1, -1) if left[k][0] >= size), None)
            if k is None:  # several documents, the longest first; one is cut if no whole one fits the gap
                left.sort(key=lambda x: (-x[0], x[1], x[2]))
                gap, kept = size, []
                for n, d, start in left:
                    if not gap or n > gap:
                        kept.append((n, d, start))
                    else:
                        pieces.append((d, start, n, sequence, size - gap))
                        gap -= n
                if gap and kept:
                    n, d, start = kept.pop()
                    pieces.append((d, start, gap, sequence, size - gap))
                    kept.append((n - gap, d, start + gap))
                    gap = 0
                left, sequence, rest, total = kept, sequence + 1, rest - size, total - size + gap
                size //= 2
                continue
            n, d, start = left.pop(k)
            pieces.append((d, start, size, sequence, 0))
            sequence, rest, total = sequence + 1, rest - size, total - size
            if n > size:
                left.append((n - size, d, start + size))
        size //= 2
    left.sort(key=lambda x: (-x[0], x[1], x[2]))
    n_seq = -(-total // capacity)
    room, cost = np.full(n_seq, capacity, np.int64), np.zeros(n_seq)
    waiting = []
    for n, d, start in left:
        at = int(np.argmin(np.where(room >= n, cost, np.inf))) if n_seq else 0
        if room[at] < n:
            waiting.append((n, d, start))
            continue
        pieces.append((d, start, n, sequence + at, int(capacity - room[at])))
        room[at] -= n
        cost[at] += linear * n + quadratic * n * n
    for n, d, start in waiting:
        while n:
            at = int(np.argmax(room))
            take = min(n, int(room[at]))
            pieces.append((d, start, take, sequence + at, int(capacity - room[at])))
            room[at] -= take
            n, start = n - take, start + take
    return pieces


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, block_tokens: int = 2_000_000, block_docs: int = 100_000, linear: float = 1.0, quadratic: float | None = None, grain: int = 128) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian, 32 bits).

    tokenizer: path of a file of the tokenizers library, the same on every machine. sequence_id is unique; a
    sequence's pieces lie gapless from offset 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sequence = encoder(tokenizer), TaskContext.get().partitionId() << 36
        held: list[tuple] = []  # (doc_id, tokens of the document, start of what is held, ids)
        waiting = 0

        def out(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            return pa.record_batch([pa.array(c, pa.int64()) for c in cols[:6]] + [pa.array(cols[6], pa.binary())], names=[x.split()[0] for x in SCHEMA.split(", ")])

        def flush() -> list[tuple]:
            nonlocal sequence, held, waiting
            found = assign(np.array([len(x[3]) for x in held], np.int64), capacity, linear, quadratic, grain)
            rows = []
            for d, start, n, seq, offset in found:
                doc, tokens, base, ids = held[d]
                rows.append((doc, base + start, n, tokens, sequence + seq, offset, ids[start : start + n].tobytes()))
            sequence += max((x[3] for x in found), default=-1) + 1
            held, waiting = [], 0
            return rows

        for part in text_slices(batches, limit=SLICE_BYTES // 2):
            ids, bounds = with_end(*enc.ids(part.column("text")), end_id)
            rows = []
            for k, doc in enumerate(part.column("doc_id").to_pylist()):
                a, b = int(bounds[k]), int(bounds[k + 1])
                whole = (b - a) // capacity * capacity
                for s in range(0, whole, capacity):
                    rows.append((doc, s, capacity, b - a, sequence, 0, ids[a + s : a + s + capacity].tobytes()))
                    sequence += 1
                if whole < b - a:
                    held.append((doc, b - a, whole, ids[a + whole : b].copy()))
                    waiting += b - a - whole
                if waiting >= block_tokens or len(held) >= block_docs:
                    rows += flush()
            if rows:
                yield out(rows)
        if rows := flush():
            yield out(rows)
        trim()

    ship(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, SCHEMA)
