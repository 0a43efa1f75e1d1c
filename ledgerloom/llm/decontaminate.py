"""Benchmark items whose windows of words occur in documents, by a prefix-filtered set join.

A window is `window` consecutive words of an item, or the whole of a shorter item. Its set is its shingles of
`shingle` words (all its words, if it has fewer). Shingles are ordered by rarity in the corpus. A window can only be
contained in a document that has each of its shingles, so its prefix is a single one, the rarest, and that is all that
is joined. A match says where the window would begin: bounds on that place and on the length left in the document drop
the rest, and what remains is verified word by word and byte by byte.

A benchmark of at most `block_bytes` of text (an index takes some 40 times that) is indexed on the driver and broadcast, so
what is broadcast is bounded; the documents are read twice (rarity, join), without a shuffle of texts. A larger benchmark
becomes tables, joined with the documents in a fixed number of passes (decontaminate_large.py). Hot sources and groups of
copies are just rows, or are joined once for each distinct text.

Null or empty texts have no words; such items match nothing and such documents are clean. Repeated items are reported by
each of their ids, repeated documents row by row. Empty tables give no rows, or no hits. Null item_ids read "null".
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.llm import decontaminate_large
from ledgerloom.llm.columns import ALNUM, Words, ngrams, text_slices
from ledgerloom.shipping import ship

SPANS = "array<struct<start:long,end:long>>"
_BITS = 20


class Sieve:
    """A sorted set of hashes behind a table of their low bits: find() is fast for hashes that are mostly absent."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes)
        self.low = np.zeros(1 << _BITS, bool)
        self.low[self._key(self.sorted)] = True

    @staticmethod
    def _key(h: np.ndarray) -> np.ndarray:
        return (h & np.uint64((1 << _BITS) - 1)).astype(np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in h whose hash is in the set, and its rank there."""
        at = np.flatnonzero(self.low[self._key(h)])
        rank = np.minimum(np.searchsorted(self.sorted, h[at]), len(self.sorted) - 1)
        sure = self.sorted[rank] == h[at]
        return at[sure], rank[sure]


class Windows:
    """The distinct windows of one length: word hashes, bytes, items and shingles."""

    def __init__(self, length: int, shingle: int, h: np.ndarray, at: np.ndarray, items: np.ndarray, text: list[bytes]):
        self.length, self.shingle = length, min(shingle, length)
        self.words = h[at[:, None] + np.arange(length)]
        _, rows, inverse = np.unique(self.words, axis=0, return_index=True, return_inverse=True)
        self.words = self.words[rows]
        self.text = [b" ".join(text[a : a + length]) for a in at[rows].tolist()]
        order = np.argsort(inverse, kind="stable")
        self.items = items[order]
        self.item_first = np.searchsorted(inverse[order], np.arange(len(rows) + 1))
        k = length - self.shingle + 1
        self.grams = ngrams(self.words.reshape(-1), np.arange(len(rows) + 1) * length, self.shingle)[0].reshape(len(rows), k)

    def join_on_rarest(self, sieve: Sieve, counts: np.ndarray) -> None:
        """Keeps the windows all of whose shingles occur, each under its rarest shingle."""
        n = counts[np.searchsorted(sieve.sorted, self.grams)]
        live = np.flatnonzero((n > 0).all(axis=1))
        offset = np.argmin(n[live], axis=1)
        token = self.grams[live, offset]
        order = np.argsort(token, kind="stable")
        self.window, self.offset = live[order], offset[order]
        self.prefix = Sieve(token)
        self.first = np.searchsorted(token[order], self.prefix.sorted)
        self.last = np.searchsorted(token[order], self.prefix.sorted, "right")


def windows_of(texts: list[str | None], window: int, shingle: int) -> list[Windows]:
    w = Words(pa.array(texts, pa.string()), ALNUM)
    h, counts, owner = w.hashes(), w.counts, w.owner()
    text = [w.data[a:b].tobytes() for a, b in zip(w.starts.tolist(), w.ends.tolist(), strict=True)]
    out = []
    for n in range(1, window + 1):
        at = ngrams(h, w.first, n)[1]
        at = at[counts[owner[at]] >= n if n == window else counts[owner[at]] == n]
        if len(at):
            out.append(Windows(n, shingle, h, at, owner[at], text))
    return out


def _rarity(docs: DataFrame, sieves: dict[int, Sieve]) -> dict[int, np.ndarray]:
    """How often each shingle of the items occurs in the corpus; one row a shingle that occurs comes to the driver."""
    shared = docs.sparkSession.sparkContext.broadcast(sieves)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {s: np.zeros(len(x.sorted), np.int64) for s, x in shared.value.items()}
        for part in text_slices(batches):
            w = Words(part.column("text"), ALNUM)
            h = w.hashes()
            for s, x in shared.value.items():
                np.add.at(total[s], x.find(ngrams(h, w.first, s)[0])[1], 1)
        for s, n in total.items():
            at = np.flatnonzero(n)
            yield pa.record_batch([pa.array(np.full(len(at), s, np.int32)), pa.array(at), pa.array(n[at])], names=["s", "rank", "n"])

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "s int, rank long, n long").groupBy("s", "rank").agg(F.sum("n").alias("n")).toArrow()
    out = {s: np.zeros(len(x.sorted), np.int64) for s, x in sieves.items()}
    kind = found.column("s").to_numpy()
    for s in out:
        out[s][found.column("rank").to_numpy()[kind == s]] = found.column("n").to_numpy()[kind == s]
    return out


def occurrences(w: Words, h: np.ndarray, index: list[Windows]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Verified occurrences in a slice of texts: first words, lengths, and the items of each."""
    grams = {s: ngrams(h, w.first, s) for s in {x.shingle for x in index}}
    owner_last = np.repeat(w.first[1:], w.counts)
    owner_first = np.repeat(w.first[:-1], w.counts)
    starts, lengths, items = [], [], []
    for x in index:
        if not len(x.window):
            continue
        hashes, places = grams[x.shingle]
        at, rank = x.prefix.find(hashes)
        n = x.last[rank] - x.first[rank]
        entry = np.repeat(x.first[rank] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        place = np.repeat(places[at], n)
        window, begin = x.window[entry], place - x.offset[entry]
        fits = (begin >= owner_first[place]) & (begin + x.length <= owner_last[place])
        window, begin = window[fits], begin[fits]
        same = (h[begin[:, None] + np.arange(x.length)] == x.words[window]).all(axis=1)
        for k, b in zip(window[same].tolist(), begin[same].tolist(), strict=True):
            words = [w.data[p:q].tobytes() for p, q in zip(w.starts[b : b + x.length].tolist(), w.ends[b : b + x.length].tolist(), strict=True)]
            if b" ".join(words) == x.text[k]:
                starts.append(b)
                lengths.append(x.length)
                items.append(x.items[x.item_first[k] : x.item_first[k + 1]])
    return np.array(starts, np.int64), np.array(lengths, np.int64), items


def _join(rows: DataFrame, index: list[Windows], names: list[str], text: bool) -> DataFrame:
    """Adds n_words, spans (in words, merged) and items to rows (row, t); t goes unless `text`."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((index, names))
    fields = [f for f in rows.schema.fields if text or f.name != "t"]
    # the row's own type, not its text: its names may need quotes
    schema = StructType(fields + StructType.fromDDL(f"n_words long, spans {SPANS}, items array<string>").fields)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, names = shared.value
        for part in text_slices(batches, "t"):
            w = Words(part.column("t"), ALNUM)
            starts, lengths, items = occurrences(w, w.hashes(), index)
            spans: list[list] = [[] for _ in range(w.n)]
            found: list[set] = [set() for _ in range(w.n)]
            order = np.argsort(starts, kind="stable")
            docs = np.searchsorted(w.first, starts[order], "right") - 1
            for d, b, n, k in zip(docs.tolist(), starts[order].tolist(), lengths[order].tolist(), order.tolist(), strict=True):
                b -= int(w.first[d])
                if spans[d] and b <= spans[d][-1]["end"]:
                    spans[d][-1]["end"] = max(spans[d][-1]["end"], b + n)
                else:
                    spans[d].append({"start": b, "end": b + n})
                found[d].update(items[k].tolist())
            listed = [sorted({names[i] for i in x}) for x in found]
            yield pa.record_batch([*(part.column(f.name) for f in fields), pa.array(w.counts.astype(np.int64)), pa.array(spans, span), pa.array(listed, pa.list_(pa.string()))], names=[*(f.name for f in fields), "n_words", "spans", "items"])

    return rows.mapInArrow(run, schema)


def covered(spans: Column) -> Column:
    """Words in the union of the spans."""
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(x["start"], acc["upto"]))).alias("n"), F.greatest(acc["upto"], x["end"]).alias("upto"))
    return F.aggregate(F.sort_array(spans), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")), step, lambda acc: acc["n"])


def hits(docs: DataFrame, benchmark: DataFrame, carry: list[str] | None = None, window: int = 13, shingle: int = 5, block_bytes: int = 4 << 20) -> DataFrame:
    """Every document: `row_` (a struct of the columns in carry, by default doc_id), `text_` if text is among them,
    n_words, spans, items, n_hit, contaminated."""
    ship(docs.sparkSession)
    carry = carry or ["doc_id"]
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).alias("n")).first().n
    keep_text = "text" in carry
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in carry if c != "text"]).alias("row"), F.col("text").cast("string").alias("t"))
    if total <= block_bytes:
        block = items.toArrow()
        index = windows_of(block.column("text").to_pylist(), window, shingle)
        sieves = {s: Sieve(np.concatenate([x.grams.reshape(-1) for x in index if x.shingle == s])) for s in {x.shingle for x in index}}
        counts = _rarity(docs, sieves) if index else {}
        for x in index:
            x.join_on_rarest(sieves[x.shingle], counts[x.shingle])
        out = _join(rows, index, block.column("item_id").to_pylist(), text=keep_text)
    else:
        found = decontaminate_large.found_by_text(docs.select(F.col("text").cast("string").alias("text")), items, window, shingle)
        out = decontaminate_large.with_words(rows, found, text=keep_text)
    out = out.withColumn("n_hit", covered(F.col("spans"))).withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))
    return out.select(F.col("row").alias("row_"), *([F.col("t").alias("text_")] if keep_text else []), "n_words", "spans", "items", "n_hit", "contaminated")


def summary(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    found = hits(docs, benchmark)
    return found.select(F.col("row_.doc_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their columns."""
    found = hits(docs, benchmark, docs.columns).filter("not contaminated")
    return found.select(*[(F.col("text_") if c == "text" else F.col(f"row_.`{c}`")).alias(c) for c in docs.columns])
