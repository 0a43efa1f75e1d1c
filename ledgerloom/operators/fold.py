"""The fold of one book: ordered commands in, events out. Plain Python, no Spark.

Price levels are a sorted list of prices and a dict of queues; a queue is a dict from id to [quantity, arrival], which
keeps arrival order and deletes in constant time, beside the level's total. Events are told to a tape: for each kind one
flat run of the numbers that the kind has, so whole batches become Arrow columns without per-event objects.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from ledgerloom.functions import codes

BUY, SELL = 0, 1
LIMIT, MARKET = 0, 1
GTC, IOC = 0, 1
ACCEPTED, REJECTED, TRADE, RESTING, CANCELLED, CANCEL_REJECTED, TOB = range(7)
DUPLICATE, UNKNOWN, ZERO, NON_POSITIVE, WRONG, MUST_BE_IOC = range(1, 7)

# The hash's start and multiplier; the start is not the usual one.
FNV_OFFSET, FNV_PRIME = 1469598103934665603, 1099511628211
MASK = (1 << 64) - 1

#: An event: kind, command_seq, event_seq, id, resting_id, side, type, tif, price, quantity, reason, engine_initiated, bid_price, bid_qty, ask_price, ask_qty
EVENT_FIELDS = ("event_code", "command_seq", "event_seq", "id", "resting_id", "side_code", "type_code", "tif_code", "price", "quantity", "reason_code", "engine_initiated", "bid_price", "bid_qty", "ask_price", "ask_qty")


#: Of each kind of event the places in EVENT_FIELDS that it has, in the order of the tape; the others are null.
FIELDS = {
    ACCEPTED: (1, 2, 3, 5, 6, 7, 8, 9), REJECTED: (1, 2, 3, 10), TRADE: (1, 2, 3, 4, 5, 8, 9), RESTING: (1, 2, 3, 5, 8, 9), CANCELLED: (1, 2, 3, 5, 8, 9, 11), CANCEL_REJECTED: (1, 2, 3, 10), TOB: (1, 2, 12, 13, 14, 15),
}
#: Stands for null on a tape: no field of an event has it.
NULL = -(1 << 63)


class Tape:
    """Events by kind. make: what holds a kind's numbers, by default a list, which takes any integer."""

    __slots__ = ("kinds",)

    def __init__(self, make=list):
        self.kinds = tuple(make() for _ in FIELDS)

    def __len__(self) -> int:
        return sum(len(self.kinds[k]) // len(at) for k, at in FIELDS.items())

    def events(self) -> list[tuple]:
        """The events as tuples of EVENT_FIELDS, in sequence."""
        out = []
        for kind, at in FIELDS.items():
            flat = iter(self.kinds[kind])
            for values in zip(*[flat] * len(at), strict=True):
                e = [None] * len(EVENT_FIELDS)
                e[0] = kind
                for k, v in zip(at, values, strict=True):
                    e[k] = None if v == NULL else bool(v) if k == 11 else v
                out.append(tuple(e))
        return sorted(out, key=lambda e: e[2])


def fnv(h: int, data: bytes) -> int:
    for b in data:
        h = ((h ^ b) * FNV_PRIME) & MASK
    return h


def fnv_u64(h: int, v: int) -> int:
    return fnv(h, (v & MASK).to_bytes(8, "little"))


class Snapshot:
    """Everything that a fold continues from; orders are (id, side, price, quantity, arrival), best price first on
    each side, bids first, in arrival order at a price."""

    __slots__ = ("arrivals", "command_seq", "event_seq", "instrument", "orders", "top")

    def __init__(self, instrument: int, command_seq: int = 0, event_seq: int = 0, arrivals: int = 0, top: tuple = (None, None, None, None), orders: list | None = None):
        self.instrument, self.command_seq, self.event_seq, self.arrivals, self.top, self.orders = instrument, command_seq, event_seq, arrivals, top, orders or []


class BookFold:
    def __init__(self, instrument: int):
        self.instrument = instrument
        self.command_seq = self.event_seq = self.arrivals = 0
        self.top: tuple = (None, None, None, None)
        self.clear()

    def clear(self) -> None:
        # bids are kept under their negated prices, so the best level of either side comes first
        self.prices: tuple[list[int], list[int]] = ([], [])
        self.levels: tuple[dict, dict] = ({}, {})  # key -> [total, {id: [quantity, arrival]}]
        self.where: dict[int, tuple[int, int]] = {}  # id -> side, key

    # book

    def rest(self, oid: int, side: int, price: int, quantity: int, arrival: int) -> None:
        key = -price if side == BUY else price
        level = self.levels[side].get(key)
        if level is None:
            insort(self.prices[side], key)
            self.levels[side][key] = [quantity, {oid: [quantity, arrival]}]
        else:
            level[0] += quantity
            level[1][oid] = [quantity, arrival]
        self.where[oid] = (side, key)

    def take(self, oid: int) -> tuple[int, int, int] | None:
        """Removes an order: side, price and remaining quantity."""
        at = self.where.pop(oid, None)
        if at is None:
            return None
        side, key = at
        level = self.levels[side][key]
        quantity = level[1].pop(oid)[0]
        level[0] -= quantity
        if not level[1]:
            self._drop(side, key)
        return side, (-key if side == BUY else key), quantity

    def reduce(self, oid: int, by: int) -> None:
        """Takes from an order's quantity; the order goes at zero. Unknown ids are ignored."""
        at = self.where.get(oid)
        if at is None:
            return
        level = self.levels[at[0]][at[1]]
        order = level[1][oid]
        if by >= order[0]:
            self.take(oid)
        else:
            order[0] -= by
            level[0] -= by

    def _drop(self, side: int, key: int) -> None:
        del self.levels[side][key]
        prices = self.prices[side]
        del prices[bisect_left(prices, key)]

    def contains(self, oid: int) -> bool:
        return oid in self.where

    def best(self, side: int) -> int | None:
        prices = self.prices[side]
        return (-prices[0] if side == BUY else prices[0]) if prices else None

    def quantity_at(self, side: int, price: int) -> int:
        level = self.levels[side].get(-price if side == BUY else price)
        return level[0] if level else 0

    def now(self) -> tuple:
        """Best bid and its quantity, best ask and its quantity; none where a side is empty."""
        b, a = self.prices
        bid = (-b[0], self.levels[BUY][b[0]][0]) if b else (None, None)
        return bid + ((a[0], self.levels[SELL][a[0]][0]) if a else (None, None))

    def orders(self) -> list[tuple[int, int, int, int, int]]:
        return [(oid, side, -key if side == BUY else key, q, arrival) for side in (BUY, SELL) for key in self.prices[side] for oid, (q, arrival) in self.levels[side][key][1].items()]

    # commands

    def cancel(self, oid: int, out: Tape) -> None:
        self.command_seq += 1
        found = self.take(oid)
        self.event_seq += 1
        if found is None:
            out.kinds[CANCEL_REJECTED].extend((self.command_seq, self.event_seq, oid, UNKNOWN))
            return
        out.kinds[CANCELLED].extend((self.command_seq, self.event_seq, oid, *found, False))
        self._tell_top(out)

    def new(self, oid: int, instrument: int, side: int, kind: int, tif: int, price: int, quantity: int, out: Tape) -> None:
        self.command_seq = cmd = self.command_seq + 1
        self.event_seq = seq = self.event_seq + 1
        reason = 0
        if instrument != self.instrument:
            reason = WRONG
        elif quantity == 0:
            reason = ZERO
        elif kind == LIMIT and price <= 0:
            reason = NON_POSITIVE
        elif kind == MARKET and tif != IOC:
            reason = MUST_BE_IOC
        elif oid in self.where:
            reason = DUPLICATE
        if reason:
            out.kinds[REJECTED].extend((cmd, seq, oid, reason))
            return
        out.kinds[ACCEPTED].extend((cmd, seq, oid, side, kind, tif, price, quantity))
        left = quantity
        other = 1 - side
        prices, levels, where = self.prices[other], self.levels[other], self.where
        limit = price if other == SELL else -price  # in the other side's keys
        tell = out.kinds[TRADE].extend
        while left and prices:
            key = prices[0]
            if kind == LIMIT and key > limit:
                break
            level = levels[key]
            queue = level[1]
            traded = -key if other == BUY else key
            gone = []
            for rid, order in queue.items():
                fill = order[0] if order[0] <= left else left
                left -= fill
                level[0] -= fill
                seq += 1
                tell((cmd, seq, oid, rid, side, traded, fill))
                if fill == order[0]:
                    gone.append(rid)
                else:
                    order[0] -= fill
                if not left:
                    break
            if len(gone) == len(queue):
                for rid in gone:
                    del where[rid]
                del levels[key]
                del prices[0]
            else:
                for rid in gone:
                    del where[rid]
                    del queue[rid]
        if left:
            seq += 1
            if kind == LIMIT and tif == GTC:
                self.arrivals += 1
                self.rest(oid, side, price, left, self.arrivals)
                out.kinds[RESTING].extend((cmd, seq, oid, side, price, left))
            else:
                out.kinds[CANCELLED].extend((cmd, seq, oid, side, price, left, True))
        self.event_seq = seq
        self._tell_top(out)

    def _tell_top(self, out: Tape) -> None:
        top = self.now()
        if top != self.top:
            self.top = top
            self.event_seq += 1
            out.kinds[TOB].extend((self.command_seq, self.event_seq, *(NULL if v is None else v for v in top)))

    # state

    def snapshot(self) -> Snapshot:
        return Snapshot(self.instrument, self.command_seq, self.event_seq, self.arrivals, self.top, self.orders())

    def restore(self, s: Snapshot) -> bool:
        """Continues from a snapshot; a bad one (another instrument, an empty order, a price that is not positive, an id
        twice) is refused and changes nothing."""
        ids = [o[0] for o in s.orders]
        if s.instrument != self.instrument or any(o[3] <= 0 or o[2] <= 0 for o in s.orders) or len(set(ids)) < len(ids):
            return False
        self.clear()
        for o in s.orders:
            self.rest(*o)
        self.command_seq, self.event_seq, self.arrivals, self.top = s.command_seq, s.event_seq, s.arrivals, tuple(s.top)
        return True

    def book_checksum(self) -> int:
        h = FNV_OFFSET
        for side in (BUY, SELL):
            h = fnv_u64(h, len(self.prices[side]))
            for key in self.prices[side]:
                queue = self.levels[side][key][1]
                h = fnv_u64(fnv_u64(h, -key if side == BUY else key), len(queue))
                for oid, (quantity, arrival) in queue.items():
                    h = fnv_u64(fnv_u64(fnv_u64(h, oid), quantity), arrival)
        return h

    def state_checksum(self) -> int:
        h = self.book_checksum()
        for v in (self.command_seq, self.event_seq, self.arrivals, self.instrument):
            h = fnv_u64(h, v)
        return h


def text_of(e: tuple) -> str:
    """The line of an event."""
    kind, cmd, seq, oid, resting, side, type_, tif, price, quantity, reason, engine, bid, bid_qty, ask, ask_qty = e
    s = codes.SIDES[side] if side is not None else None
    if kind == ACCEPTED:
        body = f"ACCEPTED id={oid} side={s} type={codes.TYPES[type_]} tif={codes.TIFS[tif]} px={price} qty={quantity}"
    elif kind in (REJECTED, CANCEL_REJECTED):
        body = f"{codes.EVENTS[kind]} id={oid} reason={codes.REASONS[reason]}"
    elif kind == TRADE:
        body = f"TRADE aggressor={oid} resting={resting} side={s} px={price} qty={quantity}"
    elif kind == RESTING:
        body = f"RESTING id={oid} side={s} px={price} qty={quantity}"
    elif kind == CANCELLED:
        body = f"CANCELLED id={oid} side={s} px={price} qty={quantity} by={'ENGINE' if engine else 'CLIENT'}"
    else:
        body = f"TOB bid={'none' if bid is None else f'{bid}x{bid_qty}'} ask={'none' if ask is None else f'{ask}x{ask_qty}'}"
    return f"seq={seq} cmd={cmd} {body}"


def hash_events(events: list[tuple], h: int = FNV_OFFSET) -> int:
    """The hash of an event stream; pass the hash so far to go on."""
    for e in events:
        h = fnv(fnv_u64(h, e[0]), text_of(e).encode())
    return h


class Lcg:
    """A reproducible source of numbers."""

    # Multiplier and increment.
    A, C = 6364136223846793005, 1442695040888963407

    def __init__(self, seed: int):
        self.state = seed & MASK

    def next(self) -> int:
        self.state = (self.state * self.A + self.C) & MASK
        return self.state >> 17

    def within(self, low: int, high: int) -> int:
        return low + self.next() % (high - low + 1)


def generated(seed: int, count: int, swap_pop: bool = False) -> list[tuple]:
    """A mixed stream of commands: (id,) cancels, (id, side, type, tif, price, quantity) is new.

    Of a hundred rolls 15 cancel a live order, 8 are market orders, 7 limit orders that do not rest, the others rest.
    swap_pop: the cancelled id's place is taken by the last live id, else later ids move up."""
    rnd, live, out, oid = Lcg(seed), [], [], 0
    for _ in range(count):
        roll = rnd.within(0, 99)
        if roll < 15 and live:
            k = rnd.within(0, len(live) - 1)
            out.append((live[k],))
            if swap_pop:
                live[k] = live[-1]
                live.pop()
            else:
                del live[k]
            continue
        side, quantity = rnd.within(0, 1), rnd.within(1, 50)
        oid += 1
        if roll >= 92:
            out.append((oid, side, MARKET, IOC, 0, quantity))
            continue
        price = rnd.within(9950, 10050)
        tif = IOC if roll >= 85 else GTC
        out.append((oid, side, LIMIT, tif, price, quantity))
        if tif == GTC:
            live.append(oid)
    return out


def apply(fold: BookFold, commands: list[tuple], tape: Tape, instrument: int | None = None) -> None:
    """Applies generated() commands; the events go to the tape."""
    for c in commands:
        if len(c) == 1:
            fold.cancel(c[0], tape)
        else:
            fold.new(c[0], fold.instrument if instrument is None else instrument, *c[1:], tape)


def run(fold: BookFold, commands: list[tuple], instrument: int | None = None) -> list[tuple]:
    """Applies generated() commands; returns the events."""
    tape = Tape()
    apply(fold, commands, tape, instrument)
    return tape.events()
