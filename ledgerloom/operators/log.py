"""Command logs as tables: gapless appends, window bounds, guarded ranges, truncation, snapshot boundaries.

A log is (node_id, seq, term, ...). Its snapshot boundary, where there is one, is a row of (node_id, boundary_seq,
boundary_term); entries up to it are gone. Sequences start at 1, and 0 is none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def appended(rows: DataFrame, order: str, node: str = "node_id", after: int = 0) -> DataFrame:
    """Rows with the next gapless sequences of their node, in `order`."""
    return rows.withColumn("seq", (F.row_number().over(W.partitionBy(node).orderBy(order)) + after).cast("long"))


def accepted(arrivals: DataFrame) -> DataFrame:
    """(node_id, seq, arrival, accepted) for entries offered to empty logs in the order of `arrival`: an entry is taken
    if it is the next after the log's last. A running state of each node, in one streaming pass over its arrivals."""
    import pyarrow as pa

    from ledgerloom.shipping import ship

    ship(arrivals.sparkSession)

    def run(batches):
        node, last = None, 0
        for batch in batches:
            ok = []
            for n, s in zip(batch.column("node_id").to_pylist(), batch.column("seq").to_pylist(), strict=True):
                if n != node:
                    node, last = n, 0
                ok.append(s == last + 1)
                last += ok[-1]
            yield pa.record_batch([*(batch.column(c) for c in ("node_id", "seq", "arrival")), pa.array(ok, pa.bool_())], names=["node_id", "seq", "arrival", "accepted"])

    rows = arrivals.select(*[F.col(c).cast("long").alias(c) for c in ("node_id", "seq", "arrival")])
    return rows.repartition("node_id").sortWithinPartitions("node_id", "arrival").mapInArrow(run, "node_id long, seq long, arrival long, accepted boolean")


def gaps(log: DataFrame) -> DataFrame:
    """Missing ranges: (node_id, after_seq, next_seq, missing)."""
    w = W.partitionBy("node_id").orderBy("seq")
    return log.withColumn("before", F.coalesce(F.lag("seq").over(w), F.lit(0).cast("long"))).filter("seq - before > 1").select("node_id", F.col("before").alias("after_seq"), F.col("seq").alias("next_seq"), F.expr("seq - before - 1").alias("missing"))


def bounds(log: DataFrame, boundary: DataFrame | None = None) -> DataFrame:
    """First and last sequence and size of each log; a boundary raises the last."""
    found = log.groupBy("node_id").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("size"))
    if boundary is None:
        return found
    both = found.join(boundary, "node_id", "full_outer")
    last = F.greatest(F.coalesce("last_seq", F.lit(0)), F.coalesce("boundary_seq", F.lit(0)))
    return both.select("node_id", F.coalesce("first_seq", last + 1).alias("first_seq"), last.alias("last_seq"), F.coalesce("size", F.lit(0)).cast("long").alias("size"))


def term_at(log: DataFrame, wanted: DataFrame, boundary: DataFrame | None = None) -> DataFrame:
    """The term of each wanted (node_id, seq): 0 at 0, the boundary's at the boundary, the entry's, or null."""
    out = wanted.join(log.select("node_id", "seq", F.col("term").alias("entry_term")), ["node_id", "seq"], "left")
    at = F.lit(None).cast("long")
    if boundary is not None:
        out = out.join(boundary, "node_id", "left")
        at = F.when(F.col("seq") == F.col("boundary_seq"), F.col("boundary_term"))
    return out.select("node_id", "seq", F.when(F.col("seq") == 0, F.lit(0).cast("long")).otherwise(F.coalesce(at, "entry_term")).alias("term"))


def entry_at(log: DataFrame, seq: int) -> DataFrame:
    return log.filter(F.col("seq") == seq)


def entries(log: DataFrame, start: int, most: int) -> DataFrame:
    """Up to `most` entries from `start`; none at all of a log whose entry `start` is gone, or not there yet."""
    has = bounds(log).filter((F.col("first_seq") <= start) & (F.col("last_seq") >= start)).select("node_id")
    return log.filter(F.col("seq").between(start, start + most - 1)).join(has, "node_id", "left_semi")


def can_serve(log: DataFrame, start: int) -> DataFrame:
    """Whether each log can go on from `start`: it has that entry, or it is the next one."""
    return bounds(log).select("node_id", ((F.lit(start) == F.col("last_seq") + 1) | ((F.lit(start) >= F.col("first_seq")) & (F.lit(start) <= F.col("last_seq")))).alias("can_serve"))


def truncated_from(log: DataFrame, seq: int) -> DataFrame:
    """Without the tail from `seq`."""
    return log.filter(F.col("seq") < seq)


def truncated_through(log: DataFrame, seq: int) -> DataFrame:
    """Without the prefix up to `seq`; numbering goes on."""
    return log.filter(F.col("seq") > seq)


def with_boundary(log: DataFrame, seq: int, term: int) -> tuple[DataFrame, DataFrame]:
    """The log beyond a snapshot and its boundary row for each node; boundaries only rise."""
    nodes = log.select("node_id").distinct()
    return truncated_through(log, seq), nodes.select("node_id", F.lit(seq).cast("long").alias("boundary_seq"), F.lit(term).cast("long").alias("boundary_term"))


def cleared(log: DataFrame) -> DataFrame:
    """A log without entries; a boundary that was there stays."""
    return log.limit(0)
