"""Helpers on columns that stay inside Spark: expressions bound once, spans of pattern matches, prefix sums."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that one block of a two-level scan holds.
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a plain alias may be inlined into a lambda and computed per element."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def scan(values: Column, zero: Column, merge: Callable[[Column, Column], Column], kind: str) -> Column:
    """For each element the merge of zero and all elements before it; merge must be associative.

    Blocks of BLOCK elements are merged first, so appending to the results costs n * BLOCK and not n * n."""
    run = lambda items, first: F.aggregate(
        items,
        F.struct(first.alias("now"), F.expr(f"cast(array() as array<{kind}>)").alias("done")),
        lambda acc, x: F.struct(merge(acc["now"], x).alias("now"), F.concat(acc["done"], F.array(acc["now"])).alias("done")),
        lambda acc: acc["done"],
    )
    blocked = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))
    many = lambda v: let(
        blocked(v),
        lambda blocks: let(
            run(F.transform(blocks, lambda b: F.aggregate(b, zero, merge)), zero),
            lambda firsts: F.flatten(F.zip_with(blocks, firsts, lambda b, f: run(b, f))),
        ),
    )
    return let(values, lambda v: F.when(F.size(v) <= BLOCK, run(v, zero)).otherwise(many(v)))


def matches(text: Column, pattern: str) -> Column:
    """All leftmost, non-overlapping matches: array of (start, end, found); places in code points, end exclusive.

    Matches are marked in the text by two characters, which first give way to a third that no pattern here matches;
    the lengths between the marks are then the places."""
    pieces = F.split(F.regexp_replace(F.translate(text, "\x01\x02", "\x03\x03"), f"(?:{pattern})", "\x01$0\x02"), "\x01", -1)

    def placed(p: Column) -> Column:
        # piece 0 lies before the first match; piece k is match k, a mark and what follows
        sizes = F.transform(p, lambda x, k: (F.length(x) - F.when(k == 0, 0).otherwise(1)).cast("long"))
        return let(
            scan(sizes, F.lit(0).cast("long"), lambda a, b: a + b, "bigint"),
            lambda starts: F.transform(
                F.slice(F.arrays_zip(starts.alias("s"), p.alias("p")), 2, F.greatest(F.size(p) - 1, F.lit(0))),
                lambda x: let(F.substring_index(x["p"], "\x02", 1), lambda m: F.struct(x["s"].alias("start"), (x["s"] + F.length(m)).alias("end"), m.alias("found"))),
            ),
        )

    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint,found:string>>)")
    return let(pieces, lambda p: F.when(F.size(p) > 1, placed(p)).otherwise(none))
