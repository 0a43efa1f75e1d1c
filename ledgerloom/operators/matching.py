"""Price-time-priority matching of command logs as a fold of each book, in Spark.

Commands go to their book by one shuffle and are sorted by sequence inside a partition; the fold then streams through
Arrow batches, so memory is one book's live orders and one batch, never a book's history. Everything that needs no book
(names, text, validation flags) is column work before or after the fold. A book is strictly sequential: parallelism is
the number of books, and a hot book costs one task as long as its commands last.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import codes
from ledgerloom.operators import fold as fold_
from ledgerloom.operators.fold import EVENT_FIELDS, FIELDS, NULL, BookFold, Snapshot, Tape
from ledgerloom.shipping import ship

COMMANDS = "book long, seq long, kind string, id long, instrument long, side string, type string, tif string, price long, quantity long"
ORDERS = "array<struct<id:long,side:string,price:long,quantity:long,arrival:long>>"
SNAPSHOTS = f"book long, last_seq long, instrument long, command_seq long, event_seq long, arrivals long, last_top struct<bid_price:long,bid_qty:long,ask_price:long,ask_qty:long>, orders {ORDERS}, book_checksum decimal(20,0), state_checksum decimal(20,0), event_hash decimal(20,0)"
#: Events that one Arrow batch of the fold's output holds, about.
BATCH_EVENTS = 50_000

_ORDER = pa.struct([("id", pa.int64()), ("side", pa.int64()), ("price", pa.int64()), ("quantity", pa.int64()), ("arrival", pa.int64())])
_TOP = pa.struct([(n, pa.int64()) for n in ("bid_price", "bid_qty", "ask_price", "ask_qty")])


def ordered(commands: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """Commands as codes (none: a cancel), with their book's in one partition and in sequence. A book's initial snapshot
    comes first."""
    c = F.col
    code = lambda name, names: F.coalesce(codes.code_of(c(name), names), F.lit(0))
    # side, type, time in force and whether the instrument is another one, in bits: fewer columns cost less on their way
    packed = code("side", codes.SIDES) + 2 * code("type", codes.TYPES) + 4 * code("tif", codes.TIFS) + F.when(c("instrument").eqNullSafe(c("book")), 0).otherwise(8)
    rows = commands.select(
        *[c(n).cast("long").alias(n) for n in ("book", "seq", "id")], F.when(c("kind") == "N", packed).cast("long").alias("code"), *[c(n).cast("long").alias(n) for n in ("price", "quantity")],
    )
    # a snapshot travels as text: a nested column would cost every command more than its fold, as Spark sizes all its
    # parts for each row of an Arrow batch
    rows = rows.withColumn("state", F.lit(None).cast("string"))
    if initial is not None:
        side = F.transform("orders", lambda o: F.array(o["id"], codes.code_of(o["side"], codes.SIDES).cast("long"), o["price"], o["quantity"], o["arrival"]))
        top = F.array(*[F.col("last_top")[n] for n in ("bid_price", "bid_qty", "ask_price", "ask_qty")])
        state = F.to_json(F.struct("last_seq", "instrument", "command_seq", "event_seq", "arrivals", top.alias("top"), side.alias("orders"), F.col("event_hash").cast("string").alias("event_hash")))
        rows = rows.unionByName(initial.select("book", F.lit(-1).cast("long").alias("seq"), state.alias("state")), allowMissingColumns=True)
    # a number of its own, or Spark would merge small partitions and fold many books in one task; more than there are
    # cores, so that books that share a partition by their hash delay few others
    n = max(int(commands.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * commands.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(n, "book").sortWithinPartitions("book", "seq")


def _folds(batches: Iterator[pa.RecordBatch], hashed: bool) -> Iterator[tuple[int, BookFold, Tape, int, int | None, bool]]:
    """(book, fold, events since the last time, last seq, hash of all events, whether the book is done)."""
    book = fold = None
    last = 0
    new_tape = lambda: Tape(lambda: array("q"))
    out = new_tape()
    h: int | None = None
    for batch in batches:
        # nulls become a number that no column has: lists of numbers are made far faster from numpy
        cols = [batch.column(k).fill_null(NULL).to_numpy() for k in range(6)]
        kinds = ((cols[3] >> bit & 1).tolist() for bit in range(4))
        states = batch.column(6) if batch.column(6).null_count < batch.num_rows else None
        for k, (b, seq, oid, code, price, quantity, side, kind, tif, foreign) in enumerate(zip(*(x.tolist() for x in cols), *kinds, strict=True)):
            if b != book or fold is None:
                if fold is not None:
                    yield book, fold, out, last, (fold_.hash_events(out.events(), h) if hashed else None), True
                book, fold, out, last, h = b, BookFold(b), new_tape(), 0, fold_.FNV_OFFSET
            if states is not None and states[k].is_valid:
                # absent values are null in arrays only, so the fields that may lack are asked for by name
                s = json.loads(states[k].as_py())
                if not fold.restore(Snapshot(s["instrument"], s["command_seq"], s["event_seq"], s["arrivals"], tuple(s["top"]), [tuple(o) for o in s["orders"]])):
                    raise ValueError(f"the snapshot of book {b} is not valid")
                h = int(s.get("event_hash") or fold_.FNV_OFFSET)
                last = s["last_seq"]
                continue
            if code == NULL:
                fold.cancel(oid, out)
            else:
                fold.new(oid, NULL if foreign else b, side, kind, tif, price, quantity, out)
            last = seq
        if len(out) >= BATCH_EVENTS:
            if hashed:
                h = fold_.hash_events(out.events(), h)
            yield book, fold, out, last, h, False
            out = new_tape()
    if fold is not None:
        yield book, fold, out, last, (fold_.hash_events(out.events(), h) if hashed else None), True


def _batch(book: int, tape: Tape) -> pa.RecordBatch | None:
    """The events of a tape, kind by kind, in one batch."""
    flat = {k: np.frombuffer(tape.kinds[k], np.int64).reshape(-1, len(at)) for k, at in FIELDS.items() if len(tape.kinds[k])}
    if not flat:
        return None
    n = sum(len(x) for x in flat.values())
    cols = []
    for place, name in enumerate(EVENT_FIELDS):
        values, none = np.zeros(n, np.int64), np.ones(n, bool)
        at = 0
        for kind, x in flat.items():
            part = slice(at, at + len(x))
            if place == 0:
                values[part], none[part] = kind, False
            elif place in FIELDS[kind]:
                values[part] = x[:, FIELDS[kind].index(place)]
                none[part] = values[part] == NULL if place >= 12 else False
            at += len(x)
        cols.append(pa.array(values.astype(bool) if name == "engine_initiated" else values, mask=none))
    return pa.record_batch([pa.array(np.full(n, book)), *cols], names=["book", *EVENT_FIELDS])


def match(commands: DataFrame, initial: DataFrame | None = None, text: bool = True) -> DataFrame:
    """The events of all books: book, event_seq, command_seq, event_type, id, ..., and their line of text. Rows come in no
    order; event_seq has it."""
    ship(commands.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for book, _, events, _, _, _ in _folds(batches, False):
            if (batch := _batch(book, events)) is not None:
                yield batch

    schema = "book long, " + ", ".join(f"{n} {'boolean' if n == 'engine_initiated' else 'long'}" for n in EVENT_FIELDS)
    c = F.col
    found = ordered(commands, initial).mapInArrow(run, schema).select(
        "book", "event_seq", "command_seq", codes.name_of(c("event_code"), codes.EVENTS).alias("event_type"), "id", "resting_id",
        codes.name_of(c("side_code"), codes.SIDES).alias("side"), codes.name_of(c("type_code"), codes.TYPES).alias("type"), codes.name_of(c("tif_code"), codes.TIFS).alias("tif"),
        "price", "quantity", codes.name_of(c("reason_code"), codes.REASONS).alias("reason"), "engine_initiated", "bid_price", "bid_qty", "ask_price", "ask_qty",
    )
    return found.withColumn("text", codes.event_text()) if text else found


def snapshots(commands: DataFrame, initial: DataFrame | None = None, hashed: bool = False) -> DataFrame:
    """The state of each book after its commands, one row a book; hashed: with the hash of its whole event stream."""
    ship(commands.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for book, fold, _, last, h, done in _folds(batches, hashed):
            if not done:
                continue
            s = fold.snapshot()
            orders = [dict(zip(("id", "side", "price", "quantity", "arrival"), o, strict=True)) for o in s.orders]
            top = dict(zip(("bid_price", "bid_qty", "ask_price", "ask_qty"), s.top, strict=True))
            yield pa.record_batch(
                [*(pa.array([v], pa.int64()) for v in (book, last, s.instrument, s.command_seq, s.event_seq, s.arrivals)), pa.array([top], _TOP), pa.array([orders], pa.list_(_ORDER)), *(pa.array([str(v) if v is not None else None], pa.string()) for v in (fold.book_checksum(), fold.state_checksum(), h))],
                names=["book", "last_seq", "instrument", "command_seq", "event_seq", "arrivals", "last_top", "orders", "book_checksum", "state_checksum", "event_hash"],
            )

    schema = "book long, last_seq long, instrument long, command_seq long, event_seq long, arrivals long, last_top struct<bid_price:long,bid_qty:long,ask_price:long,ask_qty:long>, orders array<struct<id:long,side:long,price:long,quantity:long,arrival:long>>, book_checksum string, state_checksum string, event_hash string"
    found = ordered(commands, initial).mapInArrow(run, schema)
    named = F.transform("orders", lambda o: F.struct(o["id"].alias("id"), codes.name_of(o["side"], codes.SIDES).alias("side"), o["price"].alias("price"), o["quantity"].alias("quantity"), o["arrival"].alias("arrival")))
    return found.withColumn("orders", named).withColumns({k: F.col(k).cast("decimal(20,0)") for k in ("book_checksum", "state_checksum", "event_hash")})


def book_orders(states: DataFrame) -> DataFrame:
    """The resting orders of snapshots, best price first on each side: book, side, level_rank, queue_pos, price, ..."""
    from pyspark.sql import Window as W

    one = states.select("book", F.posexplode("orders").alias("place", "o")).select("book", "place", "o.*")
    side = W.partitionBy("book", "side")
    key = F.when(F.col("side") == "BUY", -F.col("price")).otherwise(F.col("price"))
    return one.select("book", "side", F.dense_rank().over(side.orderBy(key)).cast("long").alias("level_rank"), F.row_number().over(W.partitionBy("book", "side", "price").orderBy("arrival")).cast("long").alias("queue_pos"), "price", "arrival", "id", "quantity")


def beyond(snapshot: DataFrame, log: DataFrame) -> DataFrame:
    """The log entries that a recovery replays: those beyond the snapshot of their book (beyond 0, if there is none), up to
    the first that does not follow the one before; with `after`, the snapshot's sequence. Repeated entries count once."""
    from pyspark.sql import Window as W

    fresh = log.join(snapshot.select("book", F.col("last_seq").alias("after")), "book", "left").withColumn("after", F.coalesce("after", F.lit(0).cast("long"))).filter("seq > after")
    once = fresh.dropDuplicates(["book", "seq"])
    # without gaps the n-th entry has the n-th sequence; the first that has not ends the replay, as all after it are ahead
    return once.withColumn("n_", F.row_number().over(W.partitionBy("book").orderBy("seq"))).filter("seq = after + n_").drop("n_")


def recover(snapshot: DataFrame, log: DataFrame) -> DataFrame:
    """The state after a snapshot and the log entries beyond it; entries that the snapshot has are skipped, and a gap ends
    the replay."""
    return snapshots(beyond(snapshot, log).drop("after"), snapshot)


def recovery_report(snapshot: DataFrame, log: DataFrame) -> DataFrame:
    """What recover() does with each book: had_snapshot, snapshot_seq, replayed entries, last_seq, and whether entries lie
    beyond a gap and are left out."""
    books = log.groupBy("book").agg(F.max("seq").alias("head")).join(snapshot.select("book", F.col("last_seq").alias("snapshot_seq")), "book", "full_outer")
    done = beyond(snapshot, log).groupBy("book").agg(F.count("*").alias("n"), F.max("seq").alias("to"))
    at = F.coalesce("snapshot_seq", F.lit(0).cast("long"))
    last = F.coalesce("to", at)
    return books.join(done, "book", "left").select("book", F.col("snapshot_seq").isNotNull().alias("had_snapshot"), at.alias("snapshot_seq"), F.coalesce("n", F.lit(0)).cast("long").alias("replayed"), last.alias("last_seq"), (F.coalesce("head", F.lit(0)) > last).alias("stopped_at_gap"))


def verified(states: DataFrame) -> DataFrame:
    """book and whether the stored checksums of a snapshot are those of its content."""
    again = snapshots(states.sparkSession.createDataFrame([], COMMANDS), states)
    return states.select("book", "book_checksum", "state_checksum").join(again.select("book", F.col("book_checksum").alias("b"), F.col("state_checksum").alias("s")), "book").select("book", F.expr("book_checksum = b and state_checksum = s").alias("valid"))
