"""Replay of command logs: events, the resting book, and one summary row a book.

    python -m ledgerloom.plans.replay [--instrument N] [--quiet] FILE    (FILE may be -, for standard input)
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import matching, views
from ledgerloom.sources import orders


def summary(commands: DataFrame) -> DataFrame:
    """Commands, events, event hash, book checksum and state checksum of each book."""
    return matching.snapshots(commands, hashed=True).select("book", F.col("command_seq").alias("commands"), F.col("event_seq").alias("events"), "event_hash", "book_checksum", "state_checksum")


def replay(spark: SparkSession, path: str, instrument: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events, depth of the final book and summary of an order file."""
    commands = orders.read_orders(spark, path, instrument)
    return matching.match(commands), views.depth(matching.book_orders(matching.snapshots(commands))), summary(commands)


def report(spark: SparkSession, commands: DataFrame, quiet: bool = False) -> list[str]:
    """The lines that the command prints for one book: events, levels of both sides, counts and hashes."""
    out = []
    if not quiet:
        out += [r.text for r in matching.match(commands).orderBy("event_seq").select("text").toLocalIterator()] + [""]
        levels = views.depth(matching.book_orders(matching.snapshots(commands))).collect()
        for side, title, sign in (("BUY", "bids", -1), ("SELL", "asks", 1)):
            out += [f"book {title}:"] + [f"  {r.price} x{r.quantity} ({r.orders} orders)" for r in sorted((r for r in levels if r.side == side), key=lambda r: sign * r.price)]
        out.append("")
    found = summary(commands).first()
    names = ("commands", "events", "event_hash", "book_checksum", "state_checksum")
    # an empty log has no book; its hashes are those of an empty one
    if found is None:
        from ledgerloom.operators.fold import FNV_OFFSET, BookFold

        empty = BookFold(1)
        found = dict(zip(names, (0, 0, FNV_OFFSET, empty.book_checksum(), empty.state_checksum()), strict=True))
    return out + [f"{k}={found[k]}" for k in names]


def main(args: list[str]) -> int:
    instrument, quiet, path = 1, False, None
    rest = list(args)
    while rest:
        arg = rest.pop(0)
        if arg == "--instrument" and rest:
            instrument = int(rest.pop(0))
        elif arg == "--quiet":
            quiet = True
        elif path is None and arg not in ("-h", "--help"):
            path = arg
        else:
            path = None
            break
    if path is None:
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        commands = orders.from_lines(spark, sys.stdin, instrument) if path == "-" else orders.read_orders(spark, path, instrument)
        print("\n".join(report(spark, commands, quiet)))
    except orders.MalformedError as e:
        print(f"{path}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
