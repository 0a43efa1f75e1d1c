"""Order files and cluster files: text lines to rows, with the line and message of what is malformed, and back.

Lines go through column expressions only. A file is one row when it is read, as its lines need numbers; large flows come
as many files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions import codes


class MalformedError(ValueError):
    """The first malformed line."""


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) of text files; the last line needs no line feed."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n", -1)).alias("n", "value")).select("file", (F.col("n") + 1).cast("long").alias("line_no"), "value")


def _tokens(df: DataFrame) -> DataFrame:
    """Rows with tokens `t`, without comments; blank lines go."""
    return df.withColumn("t", F.filter(F.split(F.regexp_replace("value", "#[\\s\\S]*$", ""), "[ \\t\\r\\x0b\\f]+"), lambda x: x != "")).filter(F.size("t") > 0)


def parsed_lines(df: DataFrame) -> DataFrame:
    """Every line that says something: its command's columns, or `error`. Tokens beyond those needed are ignored."""
    t = lambda k: F.get("t", F.lit(k))
    number = lambda k, signed=False: F.when(t(k).rlike(r"^[+-]?[0-9]+$" if signed else r"^\+?[0-9]+$"), t(k).try_cast("long"))
    new, cancel = t(0).isin("N", "NEW"), t(0).isin("C", "CANCEL")
    side, kind, tif = codes.word(t(2), codes.SIDE_WORDS), codes.word(t(3), codes.TYPE_WORDS), codes.word(t(4), codes.TIF_WORDS)
    numbers = number(1).isNull() | number(5, True).isNull() | number(6).isNull()
    error = (
        F.when(new & numbers, "expected: N <id> <side> <type> <tif> <price> <qty>")
        .when(new & side.isNull(), F.concat(F.lit("bad side: "), t(2)))
        .when(new & kind.isNull(), F.concat(F.lit("bad type: "), t(3)))
        .when(new & tif.isNull(), F.concat(F.lit("bad time in force: "), t(4)))
        .when(cancel & number(1).isNull(), "expected: C <id>")
        .when(~new & ~cancel, F.concat(F.lit("unknown command: "), t(0)))
    )
    only = lambda c: F.when(new, c)
    return _tokens(df).select(
        *[c for c in df.columns if c != "value"], F.when(new, "N").when(cancel, "C").alias("kind"), number(1).alias("id"), only(side).alias("side"), only(kind).alias("type"), only(tif).alias("tif"),
        only(number(5, True)).alias("price"), only(number(6)).alias("quantity"), error.alias("error"),
    )


def checked(parsed: DataFrame) -> DataFrame:
    """The rows without `error`; raises for the first malformed line, if there is one."""
    if bad := parsed.filter("error is not null").orderBy("line_no").select("line_no", "error").first():
        raise MalformedError(f"line {bad.line_no}: {bad.error}")
    return parsed.drop("error")


def _commands(rows: DataFrame, instrument: int) -> DataFrame:
    book = F.lit(instrument).cast("long")
    return rows.select(book.alias("book"), F.row_number().over(W.partitionBy("file").orderBy("line_no")).cast("long").alias("seq"), "kind", "id", F.when(F.col("kind") == "N", book).alias("instrument"), "side", "type", "tif", "price", "quantity")


def read_orders(spark: SparkSession, path: str, instrument: int = 1) -> DataFrame:
    """Commands of an order file, in file order, for one instrument."""
    return _commands(checked(parsed_lines(lines(spark, path))), instrument)


def from_lines(spark: SparkSession, source, instrument: int = 1) -> DataFrame:
    """Commands of lines that the driver has, such as standard input."""
    rows = [("-", k, line.rstrip("\n")) for k, line in enumerate(source, 1)]
    return _commands(checked(parsed_lines(spark.createDataFrame(rows, "file string, line_no long, value string"))), instrument)


def generated(spark: SparkSession, seed: int, n: int, book: int = 1) -> DataFrame:
    """The generator's stream of n commands for one book; it is sequential, so the driver makes it."""
    from ledgerloom.operators import fold
    from ledgerloom.operators.matching import COMMANDS

    rows = []
    for k, c in enumerate(fold.generated(seed, n), 1):
        new = (book, codes.SIDES[c[1]], codes.TYPES[c[2]], codes.TIFS[c[3]], c[4], c[5]) if len(c) > 1 else (None,) * 6
        rows.append((book, k, "N" if len(c) > 1 else "C", c[0], *new))
    return spark.createDataFrame(rows, COMMANDS)


def order_line() -> Column:
    """The line of a command."""
    c = F.col
    return F.when(c("kind") == "C", F.concat(F.lit("C "), c("id"))).otherwise(F.concat_ws(" ", F.lit("N"), c("id"), c("side"), c("type"), c("tif"), c("price"), c("quantity")))


def parsed_nodes(df: DataFrame) -> DataFrame:
    """Lines `node <id> <host> <port>` of cluster files: node_id, host, port, or `error`; a repeated id is an error of
    the later line."""
    t = lambda k: F.get("t", F.lit(k))
    number = lambda k: F.when(t(k).rlike(r"^\+?[0-9]+$"), t(k).try_cast("long"))
    port = number(3)
    error = (
        F.when(t(0) != "node", F.concat(F.lit("unknown directive: "), t(0)))
        .when(number(1).isNull() | t(2).isNull() | port.isNull(), "expected: node <id> <host> <port>")
        .when((port == 0) | (port > 65535), F.concat(F.lit("port out of range: "), port.cast("string")))
    )
    rows = _tokens(df).select("file", "line_no", number(1).alias("node_id"), t(2).alias("host"), port.alias("port"), error.alias("error"))
    again = F.row_number().over(W.partitionBy("file", "node_id", F.col("error").isNull()).orderBy("line_no")) > 1
    return rows.withColumn("error", F.when(F.col("error").isNull() & again, F.concat(F.lit("duplicate node id: "), F.col("node_id").cast("string"))).otherwise(F.col("error")))


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    rows = checked(parsed_nodes(lines(spark, path))).select("node_id", "host", "port")
    if not rows.take(1):
        raise MalformedError("line 0: cluster config lists no nodes")
    return rows


def find(nodes: DataFrame, node_id: int) -> DataFrame:
    return nodes.filter(F.col("node_id") == node_id)


def others(nodes: DataFrame, node_id: int) -> DataFrame:
    return nodes.filter(F.col("node_id") != node_id)


def write_events(events: DataFrame, path: str) -> None:
    """The lines of an event stream as text files, one for each book, in sequence; files are written by all tasks."""
    events.repartition("book").sortWithinPartitions("book", "event_seq").select("book", "text").write.partitionBy("book").text(path)


def write_orders(commands: DataFrame, path: str) -> None:
    """Order files, one for each book, lines in sequence."""
    commands.repartition("book").sortWithinPartitions("book", "seq").select("book", order_line().alias("value")).write.partitionBy("book").text(path)


def read_order_files(spark: SparkSession, path: str) -> DataFrame:
    """Commands of a folder of order files book=<n>/..., each for the instrument of its book."""
    rows = checked(parsed_lines(lines(spark, path).withColumn("book", F.regexp_extract("file", "book=([0-9]+)", 1).cast("long"))))
    seq = F.row_number().over(W.partitionBy("book", "file").orderBy("line_no")).cast("long")
    return rows.select("book", seq.alias("seq"), "kind", "id", F.when(F.col("kind") == "N", F.col("book")).alias("instrument"), "side", "type", "tif", "price", "quantity")
