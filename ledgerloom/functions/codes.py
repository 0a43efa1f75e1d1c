"""Codes and names of sides, order types, times in force, events and reject reasons, and scalar rules on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names by code.
SIDES = ("BUY", "SELL")
TYPES = ("LIMIT", "MARKET")
TIFS = ("GTC", "IOC")
REASONS = ("NONE", "DUPLICATE_ORDER_ID", "UNKNOWN_ORDER_ID", "ZERO_QUANTITY", "NON_POSITIVE_PRICE", "WRONG_INSTRUMENT", "MARKET_ORDER_MUST_BE_IOC")
EVENTS = ("ACCEPTED", "REJECTED", "TRADE", "RESTING", "CANCELLED", "CANCEL_REJECTED", "TOB")
# Words that order files may use.
SIDE_WORDS = {"BUY": "BUY", "B": "BUY", "SELL": "SELL", "S": "SELL"}
TYPE_WORDS = {"LIMIT": "LIMIT", "L": "LIMIT", "MARKET": "MARKET", "M": "MARKET"}
TIF_WORDS = {"GTC": "GTC", "IOC": "IOC"}


def name_of(code: Column, names: tuple[str, ...]) -> Column:
    """The name of a code; null for null, ? for a code without one."""
    return F.when(code.isNull(), None).when(code < 0, "?").otherwise(F.coalesce(F.get(F.array(*map(F.lit, names)), code.cast("int")), F.lit("?")))


def code_of(name: Column, names: tuple[str, ...]) -> Column:
    """The code of a name; null without one."""
    return F.nullif(F.array_position(F.array(*map(F.lit, names)), name), F.lit(0).cast("long")) - 1


def decoded(code: Column, names: tuple[str, ...]) -> Column:
    """The name of a code in range, else null: the row is bad."""
    return F.when(code.between(0, len(names) - 1), name_of(code, names))


def word(token: Column, words: dict[str, str]) -> Column:
    """What a token of an order file stands for; null if nothing. Case matters."""
    return F.create_map(*[F.lit(x) for pair in words.items() for x in pair])[token]


def opposite(side: Column) -> Column:
    return F.when(side == "BUY", "SELL").when(side == "SELL", "BUY")


def crosses(side: Column, kind: Column, limit: Column, resting: Column) -> Column:
    """Whether an incoming order trades with a resting price."""
    return F.when(kind == "MARKET", True).when(side == "BUY", resting <= limit).otherwise(resting >= limit)


def stateless_reason() -> Column:
    """The first rule that a new order breaks, of those that need no book; NONE if it breaks none. Cancels have null."""
    c = F.col
    return F.when(c("kind") == "C", None).when(c("instrument") != c("book"), "WRONG_INSTRUMENT").when(c("quantity") == 0, "ZERO_QUANTITY").when((c("type") == "LIMIT") & (c("price") <= 0), "NON_POSITIVE_PRICE").when((c("type") == "MARKET") & (c("tif") != "IOC"), "MARKET_ORDER_MUST_BE_IOC").otherwise("NONE")


def event_text() -> Column:
    """The line of an event."""
    c = F.col
    s = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) and p[-1:] in "= x" else c(p).cast("string") if isinstance(p, str) else p for p in parts])
    top = lambda p, q: F.when(c(p).isNull(), "none").otherwise(F.concat(c(p).cast("string"), F.lit("x"), c(q).cast("string")))
    kind = c("event_type")
    body = (
        F.when(kind == "ACCEPTED", s("ACCEPTED id=", "id", " side=", "side", " type=", "type", " tif=", "tif", " px=", "price", " qty=", "quantity"))
        .when(kind == "REJECTED", s("REJECTED id=", "id", " reason=", "reason"))
        .when(kind == "TRADE", s("TRADE aggressor=", "id", " resting=", "resting_id", " side=", "side", " px=", "price", " qty=", "quantity"))
        .when(kind == "RESTING", s("RESTING id=", "id", " side=", "side", " px=", "price", " qty=", "quantity"))
        .when(kind == "CANCELLED", s("CANCELLED id=", "id", " side=", "side", " px=", "price", " qty=", "quantity", " by=", F.when(c("engine_initiated"), "ENGINE").otherwise("CLIENT")))
        .when(kind == "CANCEL_REJECTED", s("CANCEL_REJECTED id=", "id", " reason=", "reason"))
        .when(kind == "TOB", F.concat(F.lit("TOB bid="), top("bid_price", "bid_qty"), F.lit(" ask="), top("ask_price", "ask_qty")))
    )
    return F.concat(F.lit("seq="), c("event_seq").cast("string"), F.lit(" cmd="), c("command_seq").cast("string"), F.lit(" "), body)


def rank_floor(n: Column, p: float) -> Column:
    """The 0-based place of the percentile p among n sorted values, rounded down."""
    return F.floor(F.lit(p) * (n - 1)).cast("long")


def little_endian(binary: Column, start: int, size: int) -> Column:
    """An unsigned little-endian integer of up to 8 bytes, at a 1-based place; one beyond 2^63 - 1 is an error."""
    return F.conv(F.hex(F.reverse(F.substring(binary, start, size).cast("binary")).cast("binary")), 16, 10).cast("decimal(20,0)").cast("long")


def crc_bytes(binary: Column) -> Column:
    """The four bytes of a binary's CRC-32, little-endian."""
    return F.unhex(F.concat(*[F.substring(F.lpad(F.hex(F.crc32(binary)), 8, "0"), k, 2) for k in (7, 5, 3, 1)]))
