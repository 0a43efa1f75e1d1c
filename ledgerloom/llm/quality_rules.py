"""Quality rules whose thresholds come from quantile sketches of each language and source.

Every document gets a few rates as integers. A sketch of a rate is a count for each of its buckets (a value keeps its
six leading binary digits, so a bucket is within 1/32 of its values); sketches merge by adding counts, so Spark builds
them by partial aggregation and a hot source costs one row a bucket and task. Only documents that pass the base rules are
in them. A language's sketch is the sum of those of its sources.

A fence stands where a sketch has a gap: from the quantile up that a `share` of the documents lies within, the first
empty stretch that is at least as wide as the way from the median to its beginning, and at least `unit`; the fence is in
its middle. So what lies apart from the rest of its source goes, and a source without such documents has no fence.
A source of under `min_rows` documents has the fences of its language, and so has one that is full of outliers: its
median lies within the language's fence but more of it than the share allows lies beyond. The fences are then joined to
the documents. All of it is DataFrame operations.

A null or empty text has no words and fails. Null languages and sources are groups of their own. Repeated rows and
doc_ids are judged row by row. An empty table gives no rows. Other columns are ignored by verdicts() and kept by keep().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerloom.llm.native import let
from ledgerloom.llm.store import written

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: rate: thousandths of the documents that are always inside, the narrowest gap that counts, whether there is a lower fence.
GAPS = {"symbols": (900, 20, False), "dup_lines": (980, 50, False), "repeats": (980, 30, False), "word_length": (900, 30, True)}
#: The most rows of fences that are broadcast (about 100 bytes each).
BROADCAST_ROWS = 100_000


def words(text: Column) -> Column:
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def repeated(w: Column) -> Column:
    """How many words lie in 3-word windows that occur twice or more."""

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(placed, lambda s: F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"])))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 4, 0).otherwise(let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    one = docs.select("doc_id", "lang", "source", text.alias("t"))
    in_words = let(words(F.col("t")), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated(w).alias("r")))
    lines = let(
        F.filter(F.split("t", "\n", -1), lambda x: F.translate(x, SPACES, "") != ""),
        lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d")),
    )
    counted = one.select(
        "doc_id", "lang", "source",
        in_words.alias("w"), lines.alias("l"),
        F.length(F.translate("t", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    return counted.select(
        "doc_id", "lang", "source", F.col("w.n").alias("n_words"), "word_chars", "n_symbols",
        F.col("l.d").alias("n_dup_lines"), F.col("w.r").alias("n_repeat_words"), F.col("l.n").alias("n_lines"),
    )


def rates() -> dict[str, Column]:
    per = lambda k, a, b: F.expr(f"{k} * {a} div greatest({b}, 1)")
    return {"symbols": per(1000, "n_symbols", "word_chars"), "dup_lines": per(1000, "n_dup_lines", "n_lines"), "repeats": per(1000, "n_repeat_words", "n_words"), "word_length": per(100, "word_chars", "n_words")}


def bucket(v: Column) -> Column:
    shift = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return let(shift, lambda s: F.call_function("shiftleft", F.call_function("shiftright", v, s), s))


def base_failed() -> Column:
    return F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")


def fences(features: DataFrame, min_rows: int = 100) -> DataFrame:
    """For each language and source the fences of every rate, null where there is none: columns <rate>_lo and <rate>_hi."""
    listed = F.array(*[F.struct(F.lit(k).alias("rate"), F.lit(share).alias("share"), F.lit(unit).alias("unit"), v.alias("v")) for (k, v), (share, unit, _) in zip(rates().items(), GAPS.values(), strict=True)])
    one = features.filter(~base_failed()).select("lang", "source", F.explode(listed).alias("x"))
    sketch = one.groupBy("lang", "source", "x.rate", "x.share", "x.unit", bucket(F.col("x.v")).alias("v")).agg(F.count("*").alias("n"))

    def gaps(s: DataFrame, keys: list[str]) -> DataFrame:
        w = W.partitionBy(*keys, "rate")
        up = w.orderBy("v")
        ranked = s.select("*", F.sum("n").over(up.rowsBetween(W.unboundedPreceding, 0)).alias("upto"), F.sum("n").over(w).alias("all"), F.lead("v").over(up).alias("above"), F.lag("v").over(up).alias("below"))
        placed = ranked.withColumn("mid", F.min(F.when(F.expr("2 * upto >= all"), F.col("v"))).over(w))
        high, low = F.expr("1000 * upto >= share * all"), F.expr("1000 * (all - upto + n) >= share * all")
        return placed.groupBy(*keys, "rate").agg(
            F.max("all").alias("all"), F.max("mid").alias("mid"), F.min(F.when(high, F.col("v"))).alias("edge"), F.max(F.when(low, F.col("v"))).alias("low_edge"),
            F.min(F.when(high & F.expr("above - v >= greatest(unit, v - mid)"), F.struct("v", F.expr("v + (above - v) div 2").alias("at"))))["at"].alias("hi"),
            F.max(F.when(low & F.expr("v - below >= greatest(unit, mid - v)"), F.struct("v", F.expr("v - (v - below) div 2").alias("at"))))["at"].alias("lo"),
        )

    langs = gaps(sketch.groupBy("lang", "rate", "share", "unit", "v").agg(F.sum("n").alias("n")), ["lang"])
    langs = langs.select(F.col("lang").alias("lang_"), F.col("rate").alias("rate_"), F.col("hi").alias("lang_hi"), F.col("lo").alias("lang_lo"))
    both = gaps(sketch, ["lang", "source"]).join(langs, F.expr("lang <=> lang_ and rate = rate_"))
    few = F.col("all") < min_rows
    hi = F.when(few | F.coalesce(F.expr("edge > lang_hi and mid <= lang_hi"), F.lit(False)), F.col("lang_hi")).otherwise(F.col("hi"))
    lo = F.when(few | F.coalesce(F.expr("low_edge < lang_lo and mid >= lang_lo"), F.lit(False)), F.col("lang_lo")).otherwise(F.col("lo"))
    at = both.select("lang", "source", "rate", hi.alias("hi"), lo.alias("lo"))
    aggs = []
    for k, (_, _, lower) in GAPS.items():
        aggs += [F.max(F.when(F.col("rate") == k, F.col(side))).alias(f"{k}_{side}") for side in (("hi", "lo") if lower else ("hi",))]
    return at.groupBy("lang", "source").agg(*aggs)


def judged(features: DataFrame, found: DataFrame) -> DataFrame:
    """The features with base_failed and kept."""
    f = found.withColumnsRenamed({"lang": "lang_", "source": "source_"})
    if found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        f = F.broadcast(f)
    joined = features.join(f, F.expr("lang <=> lang_ and source <=> source_"), "left")
    inside = F.lit(True)
    for k, v in rates().items():
        inside = inside & F.coalesce(bucket(v) <= F.col(f"{k}_hi"), F.lit(True))
        if GAPS[k][2]:
            inside = inside & F.coalesce(bucket(v) >= F.col(f"{k}_lo"), F.lit(True))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & inside).drop("lang_", "source_")


def verdicts(docs: DataFrame, min_rows: int = 100) -> DataFrame:
    """One row a document: doc_id, its counts, base_failed, kept and the fences of its language and source."""
    features = written(measured(docs), "quality-features")
    return judged(features, written(fences(features, min_rows), "quality-fences")).drop("lang", "source")


def keep(docs: DataFrame, min_rows: int = 100) -> DataFrame:
    """The documents that are kept, with their columns. Rows are written with their counts once, so that texts are
    measured once and never shuffled to their verdicts."""
    names = docs.columns
    # judged() sees the row's own columns only as one struct, so no name of theirs can clash
    row = docs.select(F.struct(*[docs[f"`{c}`"] for c in names]).alias("row_"))
    counted = written(measured(row.select(F.col("row_").alias("doc_id"), F.col("row_.lang").alias("lang"), F.col("row_.source").alias("source"), F.col("row_.text").alias("text"))), "quality-rows")
    found = written(fences(counted.drop("doc_id"), min_rows), "quality-fences")
    return judged(counted, found).filter("kept").select(*[F.col(f"doc_id.`{c}`").alias(c) for c in names])
