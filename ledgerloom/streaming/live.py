"""Matching of command streams: the same fold as in batch, kept as state of each book, fed in sequence.

Commands may come late, twice or out of order: what is below the next expected sequence is dropped as a duplicate, what
is beyond it waits in the state until the gap closes. The state of a book is its snapshot's bytes and the commands that
wait. A restart continues from the query's checkpoint, and a query can begin from snapshots.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerloom.functions import codes
from ledgerloom.operators.fold import EVENT_FIELDS, BookFold, Tape
from ledgerloom.shipping import ship
from ledgerloom.sources import binary

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_FIELDS = ("id", "instrument", "side", "type", "tif", "price", "quantity")
_KINDS = ", ".join(f"{n} {'boolean' if n == 'engine_initiated' else 'long'}" for n in EVENT_FIELDS)


class Matcher(StatefulProcessor):
    """One book: `next` is the sequence that is expected, `book` the fold as snapshot bytes, `waiting` what came early."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("book", "next long, content binary")
        self.waiting = handle.getMapState("waiting", "seq long", "kind string, id long, instrument long, side string, type string, tif string, price long, quantity long")

    def _load(self, book: int) -> tuple[BookFold, int]:
        fold = BookFold(book)
        if not self.state.exists():
            return fold, 1
        expected, content = self.state.get()
        fold.restore(binary.decode_snapshot(bytes(content))[0])
        return fold, expected

    def _save(self, fold: BookFold, expected: int) -> None:
        self.state.update((expected, binary.encode_snapshot(fold.snapshot(), expected - 1, 0, 0)))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        row = initialState.iloc[0]
        self.state.update((int(row["last_seq"]) + 1, bytes(row["content"])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        book = int(key[0])
        fold, expected = self._load(book)
        begun = expected
        out = Tape()
        ready: dict[int, tuple] = {}
        for part in rows:
            part = part.astype(object).where(part.notna(), None)
            for seq, *command in zip(part["seq"], part["kind"], *(part[c] for c in _FIELDS), strict=True):
                if seq >= expected:
                    ready.setdefault(int(seq), tuple(command))
        while True:
            command = ready.pop(expected, None)
            if command is None and self.waiting.containsKey((expected,)):
                command = tuple(self.waiting.getValue((expected,)))
            if command is None:
                break
            if self.waiting.containsKey((expected,)):
                self.waiting.removeKey((expected,))
            kind, oid, instrument, side, type_, tif, price, quantity = command
            if kind == "C":
                fold.cancel(int(oid), out)
            else:
                fold.new(int(oid), int(instrument), codes.SIDES.index(side), codes.TYPES.index(type_), codes.TIFS.index(tif), int(price), int(quantity), out)
            expected += 1
        for seq, command in ready.items():
            if seq > expected and not self.waiting.containsKey((seq,)):
                self.waiting.updateValue((seq,), tuple(int(v) if k in ("id", "instrument", "price", "quantity") and v is not None else v for k, v in zip(("kind", *_FIELDS), command, strict=True)))
        if expected > begun:
            self._save(fold, expected)
        if len(out):
            found = pd.DataFrame(out.events(), columns=list(EVENT_FIELDS), dtype=object)
            found.insert(0, "book", book)
            yield found

    def close(self) -> None:
        pass


def match_stream(commands: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """The events of a stream of commands, in append mode. Needs the RocksDB state store.

    initial: (book, last_seq, content) with snapshot bytes, for books that do not start empty."""
    spark = commands.sparkSession
    ship(spark)
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKSDB}")
    rows = commands.select("book", "seq", "kind", *_FIELDS)
    start = initial.select("book", "last_seq", "content").groupBy("book") if initial is not None else None
    found = rows.groupBy("book").transformWithStateInPandas(Matcher(), f"book long, {_KINDS}", "Append", "None", initialState=start)
    c = F.col
    return found.select(
        "book", "event_seq", "command_seq", codes.name_of(c("event_code"), codes.EVENTS).alias("event_type"), "id", "resting_id",
        codes.name_of(c("side_code"), codes.SIDES).alias("side"), codes.name_of(c("type_code"), codes.TYPES).alias("type"), codes.name_of(c("tif_code"), codes.TIFS).alias("tif"),
        "price", "quantity", codes.name_of(c("reason_code"), codes.REASONS).alias("reason"), "engine_initiated", "bid_price", "bid_qty", "ask_price", "ask_qty",
    ).withColumn("text", codes.event_text())


def snapshot_bytes(states: DataFrame) -> DataFrame:
    """(book, last_seq, content) of snapshots, for the start of a stream or for files."""
    ship(states.sparkSession)

    @F.pandas_udf("binary")
    def encoded(s: pd.DataFrame) -> pd.Series:
        from ledgerloom.operators.fold import Snapshot

        out = []
        for r in s.to_dict("records"):
            top = r["last_top"]
            orders = [(int(o["id"]), codes.SIDES.index(o["side"]), int(o["price"]), int(o["quantity"]), int(o["arrival"])) for o in r["orders"]]
            whole = lambda v: None if v is None or v != v else int(v)
            snap = Snapshot(int(r["instrument"]), int(r["command_seq"]), int(r["event_seq"]), int(r["arrivals"]), tuple(whole(top[k]) for k in ("bid_price", "bid_qty", "ask_price", "ask_qty")), orders)
            out.append(binary.encode_snapshot(snap, int(r["last_seq"]), 0, int(r["state_checksum"])))
        return pd.Series(out)

    return states.select("book", "last_seq", encoded(F.struct("last_seq", "instrument", "command_seq", "event_seq", "arrivals", "last_top", "orders", F.col("state_checksum").cast("string").alias("state_checksum"))).alias("content"))


def write_stream(events: DataFrame, path: str, checkpoint: str, **trigger):
    """Writes each micro-batch under its own batch_id, overwriting what a failed attempt left: every event lands once."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
