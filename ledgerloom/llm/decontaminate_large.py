"""The prefix-filtered join of decontaminate.py for benchmarks too large for one machine's index.

Windows, their shingles and the counts of these are tables. The number of passes over the documents is fixed, whatever the
size of the benchmark: one counts shingles, one finds the places of the rarest ones, one counts words, and only documents that may
have hits are joined to them. The passes drop what is in no window by a bit table of bounded size, which is broadcast;
a table too small for its benchmark lets more through and loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from ledgerloom.llm.columns import ALNUM, Words, ngrams, text_slices
from ledgerloom.llm.store import written

#: Bits a key, and the most bits in all, as powers of two: 16 bits, at most 64 MB.
BITS_A_KEY, MOST_BITS = 4, 29
#: Right shift of a key that gives its second place.
_SHIFT = 34


class Bits:
    """Two bits of a table for each key; keys() drops most keys that were not put in."""

    def __init__(self, rows: DataFrame, column: str):
        n = rows.count()
        self.log = min(max(10, n.bit_length() + BITS_A_KEY), MOST_BITS)
        mask = F.lit((1 << self.log) - 1).cast("long")
        at = rows.select(F.explode(F.array(F.col(column).bitwiseAND(mask), F.shiftrightunsigned(column, _SHIFT).bitwiseAND(mask))).alias("at"))
        found = at.groupBy(F.shiftrightunsigned("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
        self.words = np.zeros(1 << (self.log - 6), np.uint64)
        self.words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)

    def _set(self, at: np.ndarray) -> np.ndarray:
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0

    def keys(self, h: np.ndarray) -> np.ndarray:
        """Places in h (unsigned) of keys that may have been put in."""
        mask = np.uint64((1 << self.log) - 1)
        at = np.flatnonzero(self._set(h & mask))
        return at[self._set((h[at] >> np.uint64(_SHIFT)) & mask)]


def _texts(w: Words) -> list[bytes]:
    return [w.data[a:b].tobytes() for a, b in zip(w.starts.tolist(), w.ends.tolist(), strict=True)]


def _pairs(items: DataFrame, window: int) -> DataFrame:
    """(window, item_id): the windows of each item, words joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            w = Words(part.column("text"), ALNUM)
            words = _texts(w)
            for k, item in enumerate(part.column("item_id").to_pylist()):
                a, b = int(w.first[k]), int(w.first[k + 1])
                n = min(window, b - a)
                found = sorted({b" ".join(words[i : i + n]) for i in range(a, b - n + 1)}) if n else []
                yield pa.record_batch([pa.array(found, pa.binary()).cast(pa.string()), pa.array([item] * len(found), pa.string())], names=["window", "item_id"])

    return items.select("item_id", "text").mapInArrow(run, "window string, item_id string").distinct()


def _shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """(window, length, offset, key): the shingles of each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "window"):
            w = Words(part.column("window"), ALNUM)
            h, counts = w.hashes(), w.counts
            owner = w.owner()
            for s in range(1, shingle + 1):
                keys, at = ngrams(h, w.first, s)
                mine = counts[owner[at]] >= s if s == shingle else counts[owner[at]] == s
                keys, at = keys[mine], at[mine]
                if len(at):
                    k = owner[at]
                    yield pa.record_batch([part.column("window").take(pa.array(k)), pa.array(counts[k].astype(np.int32)), pa.array((at - w.first[k]).astype(np.int32)), pa.array(keys.view(np.int64))], names=["window", "length", "offset", "key"])

    return windows.mapInArrow(run, "window string, length int, offset int, key long")


def _counted(docs: DataFrame, bits: Bits, shingle: int) -> DataFrame:
    """(key, n): how often shingles that may be of windows occur in the documents."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            w = Words(part.column("text"), ALNUM)
            h = w.hashes()
            for s in range(1, shingle + 1):
                keys = ngrams(h, w.first, s)[0]
                keys, n = np.unique(keys[shared.value.keys(keys)], return_counts=True)
                yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])

    return docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _places(docs: DataFrame, bits: Bits, window: int, shingle: int) -> DataFrame:
    """(digest, place, key, before, context): where shingles that may be prefixes stand in distinct texts, with the words
    around them that a window can reach, `before` of them ahead of the place."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            w = Words(part.column("text"), ALNUM)
            h, owner = w.hashes(), w.owner()
            for s in range(1, shingle + 1):
                keys, at = ngrams(h, w.first, s)
                sure = shared.value.keys(keys)
                keys, at = keys[sure], at[sure]
                if not len(at):
                    continue
                reach = max(0, window - shingle) if s == shingle else 0
                doc = owner[at]
                low, high = np.maximum(at - reach, w.first[doc]), np.minimum(at + s + reach, w.first[doc + 1])
                context = [b" ".join([w.data[p:q].tobytes() for p, q in zip(w.starts[a:b].tolist(), w.ends[a:b].tolist(), strict=True)]) for a, b in zip(low.tolist(), high.tolist(), strict=True)]
                yield pa.record_batch(
                    [part.column("digest").take(pa.array(doc)), pa.array(at - w.first[doc]), pa.array(keys.view(np.int64)), pa.array((at - low).astype(np.int32)), pa.array(context, pa.large_binary()).cast(pa.large_string()).cast(pa.string())],
                    names=["digest", "place", "key", "before", "context"],
                )

    found = docs.select("digest", "text").mapInArrow(run, "digest string, place long, key long, before int, context string")
    return found.groupBy("digest", "place", "key").agg(F.first("before").alias("before"), F.first("context").alias("context"))


def digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def found_by_text(docs: DataFrame, items: DataFrame, window: int, shingle: int) -> DataFrame:
    """(digest, spans, items) of the distinct texts with hits; docs has text, items have item_id and text. Written."""
    texts = docs.select("text", digest(F.col("text")).alias("digest"))
    pairs = written(_pairs(items, window), "windows")
    grams = written(_shingles(pairs.select("window").distinct(), shingle), "shingles")
    n = _counted(texts, Bits(grams, "key"), shingle)
    best = grams.join(n, "key").groupBy("window").agg(F.first("length").alias("length"), F.count("*").alias("live"), F.min(F.struct("n", "offset", "key")).alias("best"))
    # a window with a shingle that never occurs can occur nowhere
    best = best.filter(F.col("live") == F.col("length") - F.least(F.lit(shingle), "length") + 1).select("window", "length", F.col("best.offset").alias("offset"), F.col("best.key").alias("key"))
    best = written(best, "prefixes")
    places = _places(texts, Bits(best, "key"), window, shingle)
    # bounds on the place, then all words; a slice that the end of the text cuts short differs from the window
    same = (F.col("offset") <= F.col("before")) & (F.array_join(F.slice(F.split("context", " "), F.col("before") - F.col("offset") + 1, F.col("length")), " ") == F.col("window"))
    hit = places.join(best, "key").filter(same).select("digest", (F.col("place") - F.col("offset")).alias("start"), (F.col("place") - F.col("offset") + F.col("length")).alias("end"), "window")
    hit = written(hit, "hits")
    order = Window.partitionBy("digest").orderBy("start", "end")
    ahead = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = hit.select("digest", "start", "end").distinct().withColumn("new", F.when(F.col("start") <= ahead, 0).otherwise(1)).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("digest", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = runs.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    named = hit.select("digest", "window").distinct().join(pairs, "window").groupBy("digest").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    return written(spans.join(named, "digest"), "found")


def with_words(rows: DataFrame, found: DataFrame, text: bool) -> DataFrame:
    """Rows (row, t) with n_words, spans and items; t goes unless `text`. Only texts that may have hits are shuffled."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(Bits(found.select(F.xxhash64("digest").alias("key")), "key"))
    keyed = rows.withColumn("digest", digest(F.col("t"))).withColumn("key", F.xxhash64("digest"))
    kept = [f for f in keyed.schema.fields if f.name != "key" and (text or f.name != "t")]
    schema = StructType([*kept, StructField("n_words", LongType()), StructField("maybe", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "t"):
            maybe = np.zeros(part.num_rows, bool)
            maybe[shared.value.keys(part.column("key").to_numpy().view(np.uint64))] = True
            counts = Words(part.column("t"), ALNUM).counts.astype(np.int64)
            yield pa.record_batch([*(part.column(f.name) for f in kept), pa.array(counts), pa.array(maybe)], names=[f.name for f in schema])

    words = keyed.mapInArrow(run, schema)
    none = {"spans": F.expr("cast(array() as array<struct<start:long,end:long>>)"), "items": F.expr("cast(array() as array<string>)")}
    clean = words.filter("not maybe").select("*", *[x.alias(k) for k, x in none.items()])
    hit = words.filter("maybe").join(found, "digest", "left").withColumns({k: F.coalesce(k, x) for k, x in none.items()})
    return clean.unionByName(hit).drop("digest", "maybe")
