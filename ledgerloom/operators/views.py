"""Relational views of books and event streams: levels, tops, trades, and the book rebuilt from events alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions import codes


def static_book(commands: DataFrame) -> DataFrame:
    """All valid resting limit orders as if nothing ever matched: level operators on it have a plain SQL equivalent."""
    return commands.filter((codes.stateless_reason() == "NONE") & (F.col("type") == "LIMIT") & (F.col("tif") == "GTC")).select("book", "side", "price", "id", "quantity", F.col("seq").alias("arrival"))


def depth(orders: DataFrame) -> DataFrame:
    """Total quantity and order count of each level."""
    return orders.groupBy("book", "side", "price").agg(F.sum("quantity").cast("long").alias("quantity"), F.count("*").alias("orders"))


def top_of_book(orders: DataFrame) -> DataFrame:
    """Best price and its quantity of each side of each book; null for an empty side."""
    best = F.max(F.when(F.col("side") == "BUY", F.struct("price", "quantity"))), F.min(F.when(F.col("side") == "SELL", F.struct("price", "quantity")))
    tops = depth(orders).groupBy("book").agg(best[0].alias("b"), best[1].alias("a"))
    return tops.select("book", F.col("b.price").alias("bid_price"), F.col("b.quantity").alias("bid_qty"), F.col("a.price").alias("ask_price"), F.col("a.quantity").alias("ask_qty"))


def quantity_at(orders: DataFrame, side: str, price: int) -> DataFrame:
    """The total of one level of each book, 0 where there is none."""
    at = (F.col("side") == side) & (F.col("price") == price)
    return orders.groupBy("book").agg(F.coalesce(F.sum(F.when(at, F.col("quantity"))), F.lit(0)).cast("long").alias("quantity"))


def order_counts(orders: DataFrame) -> DataFrame:
    return orders.groupBy("book").agg(F.count("*").alias("orders"), (F.count("*") == 0).alias("is_empty"))


def walk(orders: DataFrame) -> DataFrame:
    """Orders with their place in the walk of their side: best price first, in arrival order at a price."""
    key = F.when(F.col("side") == "BUY", -F.col("price")).otherwise(F.col("price"))
    return orders.select("book", "side", F.row_number().over(W.partitionBy("book", "side").orderBy(key, "arrival")).cast("long").alias("place"), "price", "arrival", "id", "quantity")


def front_level(orders: DataFrame) -> DataFrame:
    """The orders at the best price of each side."""
    key = F.when(F.col("side") == "BUY", -F.col("price")).otherwise(F.col("price"))
    return orders.withColumn("level", F.dense_rank().over(W.partitionBy("book", "side").orderBy(key))).filter("level = 1").drop("level")


#: Quantity that one bucket of sweep()'s join covers.
SWEEP_BUCKET = 64


def sweep(orders: DataFrame, aggressors: DataFrame) -> DataFrame:
    """What each single aggressor (book, id, side, type, price, quantity) would trade with a book as it stands.

    The quantity that lies before an order in its side's priority does not depend on the aggressor, so it is summed once;
    an aggressor of quantity q meets the orders before which there is less than q. That is a range join, by buckets of
    quantity: an aggressor reaches no more buckets than the side fills."""
    key = F.when(F.col("side") == "BUY", -F.col("price")).otherwise(F.col("price"))
    w = W.partitionBy("book", "side").orderBy(key, "arrival")
    queued = orders.withColumn("before", F.coalesce(F.sum(F.col("quantity").cast("decimal(38,0)")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("decimal(38,0)")))
    total = orders.groupBy("book", "side").agg(F.sum(F.col("quantity").cast("decimal(38,0)")).alias("total"))
    a = aggressors.select("book", codes.opposite(F.col("side")).alias("side"), *[F.col(c).alias(f"a_{c}") for c in ("id", "side", "type", "price", "quantity")]).filter("a_quantity > 0")
    bucket = lambda c: F.floor(c / SWEEP_BUCKET).cast("long")
    reach = a.join(total, ["book", "side"]).withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), bucket(F.least(F.col("a_quantity").cast("decimal(38,0)"), F.col("total")) - 1)))).drop("total")
    met = reach.join(queued.withColumn("bucket", bucket(F.col("before"))), ["book", "side", "bucket"]).filter((F.col("before") < F.col("a_quantity")) & codes.crosses(F.col("a_side"), F.col("a_type"), F.col("a_price"), F.col("price")))
    fill = F.least(F.col("quantity"), (F.col("a_quantity") - F.col("before")).cast("long"))
    return met.select("book", F.col("a_id").alias("aggressor_id"), F.col("id").alias("resting_id"), "price", fill.alias("quantity"))


def crossing_levels(orders: DataFrame) -> DataFrame:
    """Pairs of a bid and an ask level of a book whose prices cross; levels, not orders, so pairs stay few."""
    d = depth(orders)
    b = d.filter("side = 'BUY'").select("book", F.col("price").alias("bid_price"), F.col("quantity").alias("bid_qty"))
    a = d.filter("side = 'SELL'").select("book", F.col("price").alias("ask_price"), F.col("quantity").alias("ask_qty"))
    return b.join(a, "book").filter(codes.crosses(F.lit("BUY"), F.lit("LIMIT"), F.col("bid_price"), F.col("ask_price")))


def by_type(events: DataFrame) -> DataFrame:
    return events.groupBy("book", "event_type").agg(F.count("*").alias("events"))


def nth(events: DataFrame, event_type: str, n: int) -> DataFrame:
    """The n-th event of a type in each book, from 1."""
    w = W.partitionBy("book").orderBy("event_seq")
    return events.filter(F.col("event_type") == event_type).withColumn("n", F.row_number().over(w)).filter(F.col("n") == n).drop("n")


def trades(events: DataFrame) -> DataFrame:
    return events.filter("event_type = 'TRADE'").select("book", "event_seq", "command_seq", F.col("id").alias("aggressor_id"), "resting_id", "side", "price", "quantity")


def tob_changes(events: DataFrame) -> DataFrame:
    """Tops of book with the one before; null-safe, a repeated top drops out."""
    w = W.partitionBy("book").orderBy("event_seq")
    fields = ("bid_price", "bid_qty", "ask_price", "ask_qty")
    tops = events.filter("event_type = 'TOB'").select("book", "event_seq", "command_seq", *fields, F.lag(F.struct(*fields)).over(w).alias("before"))
    return tops.filter(F.col("before").isNull() | ~F.struct(*fields).eqNullSafe(F.col("before"))).select("book", "event_seq", "command_seq", *fields, F.col("before.bid_price").alias("prev_bid_price"), F.col("before.ask_price").alias("prev_ask_price"))


def quotes_at_trades(events: DataFrame) -> DataFrame:
    """Our own: each trade with the quote in force when its command came (the last top of an earlier command)."""
    w = W.partitionBy("book").orderBy("event_seq").rowsBetween(W.unboundedPreceding, -1)
    last = F.last(F.when(F.col("event_type") == "TOB", F.struct("bid_price", "ask_price")), ignorenulls=True).over(w)
    return events.withColumn("quote", last).filter("event_type = 'TRADE'").select("book", "event_seq", "side", "price", "quantity", F.col("quote.bid_price").alias("bid_price"), F.col("quote.ask_price").alias("ask_price"))


def bars(events: DataFrame, commands_per_bar: int) -> DataFrame:
    """Our own: open, high, low, close and volume of trades over runs of commands (time here is the sequence)."""
    t = trades(events).withColumn("bar", F.floor((F.col("command_seq") - 1) / commands_per_bar))
    return t.groupBy("book", "bar").agg(F.min_by("price", "event_seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "event_seq").alias("close"), F.sum("quantity").alias("volume"))


def book_from_events(events: DataFrame) -> DataFrame:
    """The resting orders after an event stream, from the events alone.

    Ids may be used again, so an order is an incarnation of its id: it opens at a RESTING event and lasts until the next
    one of that id. One window over each book and id numbers the incarnations of all events that touch the id; what
    traded and what the client cancelled in an incarnation is then a sum, without a range join."""
    touched = events.filter("event_type in ('RESTING', 'TRADE', 'CANCELLED')").select(
        "book", "event_seq", F.when(F.col("event_type") == "TRADE", F.col("resting_id")).otherwise(F.col("id")).alias("id"), "event_type", "side", "price", "quantity", "engine_initiated",
    )
    live = touched.filter("event_type <> 'CANCELLED' or not engine_initiated")
    rests = F.col("event_type") == "RESTING"
    w = W.partitionBy("book", "id").orderBy("event_seq").rowsBetween(W.unboundedPreceding, 0)
    numbered = live.withColumn("n", F.sum(rests.cast("int")).over(w)).filter("n > 0")
    opened = lambda c: F.max(F.when(rests, F.col(c))).alias(c)
    left = F.sum(F.when(rests, F.col("quantity")).otherwise(-F.col("quantity")))
    return numbered.groupBy("book", "id", "n").agg(opened("side"), opened("price"), left.cast("long").alias("quantity"), F.max(F.when(rests, F.col("event_seq"))).alias("rested_at")).filter("quantity > 0").select("book", "side", "price", "rested_at", "id", "quantity")


def rests_in_order(orders: DataFrame, key: str) -> DataFrame:
    """Orders with their place in their level's queue by arrival."""
    return orders.select("book", "side", "price", "id", "quantity", F.row_number().over(W.partitionBy("book", "side", "price").orderBy(key)).cast("long").alias("queue_pos"))


def percentile_floor(df: DataFrame, value: str, p: float, *keys: str) -> DataFrame:
    """The value at rank floor(p * (n - 1)) of each group; 0 for none. Exact, not interpolated."""
    w = W.partitionBy(*keys)
    ranked = df.filter(F.col(value).isNotNull()).select(*keys, value, F.row_number().over(w.orderBy(value)).alias("r"), F.count("*").over(w).alias("n"))
    return ranked.filter(F.col("r") - 1 == codes.rank_floor(F.col("n"), p)).select(*keys, F.col(value).alias("percentile"))




def reduced(orders: DataFrame, by: DataFrame) -> DataFrame:
    """A book after quantities were taken from its orders (by: book, id, by); an order that has no more goes, ids that are
    not there are ignored."""
    taken = by.groupBy("book", "id").agg(F.sum("by").alias("by"))
    left = orders.join(taken, ["book", "id"], "left").withColumn("quantity", (F.col("quantity") - F.coalesce("by", F.lit(0))).cast("long"))
    return left.filter("quantity > 0").select("book", "side", "price", "id", "quantity")
