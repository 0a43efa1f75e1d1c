"""What every event stream and book must satisfy, each as a query that returns the violations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def conservation(events: DataFrame, orders: DataFrame) -> DataFrame:
    """Books in which accepted quantity is not twice the traded plus the cancelled plus the resting quantity."""
    q = lambda kind: F.coalesce(F.sum(F.when(F.col("event_type") == kind, F.col("quantity").cast("decimal(38,0)"))), F.lit(0))
    flows = events.groupBy("book").agg(q("ACCEPTED").alias("accepted"), q("TRADE").alias("traded"), q("CANCELLED").alias("cancelled"))
    rest = orders.groupBy("book").agg(F.sum(F.col("quantity").cast("decimal(38,0)")).alias("resting"))
    both = flows.join(rest, "book", "left").withColumn("resting", F.coalesce("resting", F.lit(0)))
    return both.filter("accepted <> 2 * traded + cancelled + resting").select("book")


def uncrossed(orders: DataFrame) -> DataFrame:
    """Books whose best bid is at or above the best ask."""
    best = orders.groupBy("book").agg(F.max(F.when(F.col("side") == "BUY", F.col("price"))).alias("bid"), F.min(F.when(F.col("side") == "SELL", F.col("price"))).alias("ask"))
    return best.filter("bid >= ask").select("book")


def queue_order(orders: DataFrame) -> DataFrame:
    """Orders that are empty, or whose arrival is not after that of the order before them at their price."""
    w = W.partitionBy("book", "side", "price").orderBy("queue_pos")
    return orders.withColumn("before", F.lag("arrival").over(w)).filter("quantity <= 0 or arrival <= before").select("book", "id")


def trade_within_limit(events: DataFrame, commands: DataFrame) -> DataFrame:
    """Trades at a price beyond their aggressor's limit; the command is the one whose sequence the trade carries."""
    sent = commands.filter("kind = 'N' and type = 'LIMIT'").select("book", F.col("seq").alias("command_seq"), F.col("price").alias("limit"), F.col("side").alias("its_side"))
    t = events.filter("event_type = 'TRADE'").select("book", "event_seq", "command_seq", "price")
    return t.join(sent, ["book", "command_seq"]).filter("(its_side = 'BUY' and price > limit) or (its_side = 'SELL' and price < limit)").select("book", "event_seq")


def gapless(events: DataFrame) -> DataFrame:
    """Events whose sequence is not the one after the event before."""
    w = W.partitionBy("book").orderBy("event_seq")
    return events.withColumn("before", F.coalesce(F.lag("event_seq").over(w), F.lit(0))).filter("event_seq <> before + 1").select("book", "event_seq")


def silent_commands(events: DataFrame, commands: DataFrame) -> DataFrame:
    """Commands without any event."""
    return commands.select("book", F.col("seq").alias("command_seq")).join(events.select("book", "command_seq"), ["book", "command_seq"], "left_anti")


def late_tops(events: DataFrame) -> DataFrame:
    """Tops of book that are not the last event of their command, or not the only one."""
    w = W.partitionBy("book", "command_seq").orderBy("event_seq")
    return events.withColumn("after", F.lead("event_seq").over(w)).filter("event_type = 'TOB' and after is not null").select("book", "event_seq")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that are in one but not in the other, with repetitions."""
    return a.exceptAll(b).unionAll(b.exceptAll(a))
