"""A quality score of each text by a generalised additive model with pairwise interactions.

The model is fitted on at most `sample` labelled documents, chosen by a hash of doc_id, without the held-out ones;
the texts of the sample only are measured for it. Then every whole text is measured and scored: its features become bins,
and the score is a sum of entries of the bins' tables. Features come from the text alone.

Null texts are empty; an empty text has a score like any other. A doc_id with several labels takes the largest; null
labels and doc_ids teach nothing. Without labels every score is 0.5. Repeated rows are scored row by row; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.boosting import Additive
from ledgerloom.llm.columns import NOT_SPACE, Words, buffers, code_points, ngrams, text_slices
from ledgerloom.shipping import ship

FEATURES = ("log_chars", "log_words", "word_length", "marks", "pipes", "shouts", "upper", "digits", "stops", "outside", "line_length", "dup_lines", "new_words", "new_trigrams", "short_words", "top_word")
_LINE = np.ones(256, bool)
_LINE[0x0A] = False


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_MARKS, _PIPES, _SHOUTS, _STOPS = _table("#*$%&<>"), _table("|"), _table("!"), _table(".,;:?")
_UPPER, _DIGITS = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("0123456789")


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES a text."""
    data, offsets = buffers(texts)

    def count(table: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(table[data])])
        return np.diff(sums[offsets])

    chars = np.diff(code_points(data)[offsets])
    w = Words(texts, NOT_SPACE)
    h, n = w.hashes(), w.counts
    lines = Words(texts, _LINE, lower=False)
    line_hash = lines.hashes()
    tri, at = ngrams(h, w.first, 3)
    tri_first = np.searchsorted(at, w.first)
    size = w.ends - w.starts
    small = np.concatenate([[0], np.cumsum(size <= 3)])
    per = np.maximum(n, 1)
    fresh, top, fresh_tri, dup = (np.ones(w.n) for _ in range(4))
    for d in range(w.n):
        a, b = w.first[d], w.first[d + 1]
        if a < b:
            _, k = np.unique(h[a:b], return_counts=True)
            fresh[d], top[d] = len(k) / (b - a), k.max() / (b - a)
        a, b = tri_first[d], tri_first[d + 1]
        if a < b:
            fresh_tri[d] = len(np.unique(tri[a:b])) / (b - a)
        a, b = lines.first[d], lines.first[d + 1]
        dup[d] = 1 - len(np.unique(line_hash[a:b])) / (b - a) if a < b else 0
    in_words = np.diff(np.concatenate([[0], np.cumsum(size)])[w.first])
    outside = np.diff(np.concatenate([[0], np.cumsum(data >= 0x80)])[offsets])
    c = np.maximum(chars, 1)
    return np.stack([
        np.log1p(chars), np.log1p(n), in_words / per, count(_MARKS) / per, count(_PIPES) / per, count(_SHOUTS) / per, count(_UPPER) / c, count(_DIGITS) / c,
        count(_STOPS) / per, outside / c, np.log1p(n / np.maximum(lines.counts, 1)), dup, fresh, fresh_tri, np.diff(small[w.first]) / per, top,
    ], 1).astype(float)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> Additive:
    """The model; the driver gets at most `sample` rows of features: one for each doc_id of the sample, and of texts with
    the same doc_id the one whose hash is the least."""
    ship(docs.sparkSession)
    known = labels.filter("doc_id is not null and quality is not null").filter(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    # buckets of a hash, some 256 rows each: the first of them make the sample, without sorting labels or sending more of
    # them to the driver; the limit only makes the bound certain
    n = known.count()
    m = max(1, -(-n // 256))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(m)) < max(1, int(0.95 * sample / 256))).limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("doc_id")).select("doc_id", "quality", F.xxhash64("text").alias("key"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            yield pa.record_batch([*(part.column(c) for c in ("doc_id", "quality", "key")), pa.array(features(part.column("text")).tolist(), pa.list_(pa.float64()))], names=["doc_id", "quality", "key", "x"])

    each = rows.mapInArrow(run, "doc_id long, quality int, key long, x array<double>")
    got = each.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min_by("x", "key").alias("x")).toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    y = got.column("quality").to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # the order of rows must not matter
    return Additive().fit(x[order], y[order])


def score(docs: DataFrame, model: Additive) -> DataFrame:
    """doc_id, score of every document."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            yield pa.record_batch([part.column("doc_id"), pa.array(model.probability(features(part.column("text"))))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, by a model of the labels that are not held out."""
    return score(docs, fit(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
