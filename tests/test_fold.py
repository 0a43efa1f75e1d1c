import golden
import pytest
from ledgerloom.operators import fold as f

INSTRUMENT = 42


def play(text: str, instrument: int = INSTRUMENT):
    book = f.BookFold(instrument)
    return book, f.run(book, golden.commands(text))


def kinds(events):
    return [e[0] for e in events]


def traded(events):
    return [(e[4], e[8], e[9]) for e in events if e[0] == f.TRADE]


def test_sample_stream_has_the_pinned_hashes():
    book, events = play(golden.SAMPLE, 1)
    assert len(events) == 49 and book.command_seq == 17 and book.arrivals == 9
    assert (f.hash_events(events), book.book_checksum(), book.state_checksum()) == golden.SAMPLE_HASHES
    assert book.orders() == [(14, f.BUY, 100, 5, 9)]
    lines = golden.SAMPLE_EVENTS.split("\n")[1:-1]
    assert [f.text_of(e) for e in events[: len(lines)]] == lines


def test_aliases_and_trailing_words_mean_the_same():
    assert golden.commands(golden.ALIASES) == golden.commands(golden.PLAIN)


def test_prefix_of_the_sample():
    book = f.BookFold(1)
    assert len(f.run(book, golden.commands(golden.SAMPLE)[:12])) == 34
    assert book.state_checksum() == golden.SAMPLE_12_STATE and not book.orders() and book.arrivals == 6


def test_eight_commands_make_22_events():
    book, events = play("N 1 BUY LIMIT GTC 100 10\nN 2 BUY LIMIT GTC 100 5\nN 3 SELL LIMIT GTC 101 8\nN 4 SELL LIMIT GTC 100 12\nC 2\nC 2\nN 5 BUY MARKET IOC 0 20\nN 6 SELL LIMIT IOC 99 4")
    assert len(events) == 22 and not book.orders()
    assert f.text_of(events[-1]) == "seq=22 cmd=8 CANCELLED id=6 side=SELL px=99 qty=4 by=ENGINE"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("N 1 B L GTC 100 5\nN 2 B L GTC 100 5\nN 3 S L GTC 100 5", [(1, 100, 5)]),  # time priority
        ("N 1 B L GTC 100 1\nN 2 B L GTC 100 1000\nN 3 S L GTC 100 1", [(1, 100, 1)]),  # size gives none
        ("N 1 B L GTC 100 5\nN 2 B L GTC 101 5\nN 3 S L GTC 100 10", [(2, 101, 5), (1, 100, 5)]),  # price beats time
        ("N 1 S L GTC 101 5\nN 2 S L GTC 100 5\nN 3 S L GTC 100 5\nN 4 B L GTC 101 15", [(2, 100, 5), (3, 100, 5), (1, 101, 5)]),
        ("N 1 B L GTC 100 5\nN 2 B L GTC 100 5\nC 1\nN 1 B L GTC 100 5\nN 3 S L GTC 100 5", [(2, 100, 5)]),  # re-entry loses priority
        ("N 1 S L GTC 100 10\nN 2 B L GTC 110 10", [(1, 100, 10)]),  # price improvement
        ("N 1 S L GTC 100 10\nN 2 S L GTC 100 10\nN 3 B L GTC 100 3\nN 4 B L GTC 100 7", [(1, 100, 3), (1, 100, 7)]),  # a partial keeps its place
        ("N 1 S L GTC 100 5\nN 2 S L GTC 101 5\nN 3 S L GTC 102 5\nN 4 B L GTC 101 12", [(1, 100, 5), (2, 101, 5)]),  # the limit stops the sweep
        ("N 1 S L GTC 100 5\nN 2 S L GTC 200 5\nN 3 S L GTC 300 5\nN 4 B M IOC 0 12", [(1, 100, 5), (2, 200, 5), (3, 300, 2)]),
        ("N 1 S L GTC 100 4611686018427387903\nN 2 B L GTC 100 4611686018427387903", [(1, 100, 4611686018427387903)]),
        ("N 1 B L GTC 100 10\nN 2 S L GTC 100 10", [(1, 100, 10)]),  # one's own orders cross
    ],
)
def test_trades(text, want):
    assert traded(play(text)[1]) == want


def test_residual_rests_and_no_book_is_crossed():
    book, events = play("N 1 S L GTC 100 4\nN 2 B L GTC 100 10")
    assert book.orders() == [(2, f.BUY, 100, 6, 2)] and book.best(f.SELL) is None
    book, _ = play("N 1 S L GTC 100 10\nN 2 B L GTC 105 4")
    assert book.best(f.SELL) == 100 and book.best(f.BUY) is None


def test_immediate_orders_never_rest():
    for text, left in (("N 1 B M IOC 0 10", 10), ("N 1 S L GTC 100 4\nN 2 B L IOC 100 10", 6), ("N 1 S L GTC 105 4\nN 2 B L IOC 100 10", 10)):
        _, events = play(text)
        cancelled = [e for e in events if e[0] == f.CANCELLED]
        assert [(e[9], e[11]) for e in cancelled] == [(left, True)]
    assert f.TOB not in kinds(play("N 1 B M IOC 0 10")[1])


@pytest.mark.parametrize(
    ("command", "instrument", "reason"),
    [((1, 0, 0, 0, 100, 0), 42, f.ZERO), ((1, 0, 0, 0, 0, 5), 42, f.NON_POSITIVE), ((1, 0, 0, 0, -5, 5), 42, f.NON_POSITIVE), ((1, 0, 0, 0, 100, 0), 7, f.WRONG), ((1, 0, 1, 0, 0, 5), 42, f.MUST_BE_IOC)],
)
def test_rejects_take_the_first_rule(command, instrument, reason):
    book = f.BookFold(INSTRUMENT)
    events = f.run(book, [command], instrument)
    assert [(e[0], e[10]) for e in events] == [(f.REJECTED, reason)]
    f.run(book, [(99,)])
    assert book.command_seq == 2  # rejects take a sequence


def test_ids_are_unique_among_live_orders_only():
    _, events = play("N 1 B L GTC 100 5\nN 1 B L GTC 101 5")
    assert events[-1][0] == f.REJECTED and events[-1][10] == f.DUPLICATE
    _, events = play("N 1 B L GTC 100 5\nC 1\nN 1 B L GTC 100 5")
    assert kinds(events).count(f.ACCEPTED) == 2


def test_cancels():
    _, events = play("C 9")
    assert [(e[0], e[10]) for e in events] == [(f.CANCEL_REJECTED, f.UNKNOWN)]
    _, events = play("N 1 B L GTC 100 10\nN 2 B L GTC 99 10\nC 2")
    assert events[-1][0] == f.CANCELLED and events[-1][11] is False  # no new top below the best


def test_book_operators():
    book, _ = play("N 1 B L GTC 100 10\nN 2 B L GTC 100 5\nN 3 S L GTC 103 7\nN 4 B L GTC 99 1")
    assert book.quantity_at(f.BUY, 100) == 15 and book.quantity_at(f.SELL, 104) == 0 and book.contains(3)
    book.reduce(1, 4)
    assert book.quantity_at(f.BUY, 100) == 11 and book.now() == (100, 11, 103, 7)
    book.reduce(1, 6)
    book.reduce(77, 5)
    assert not book.contains(1) and book.take(2) == (f.BUY, 100, 5) and book.best(f.BUY) == 99


def test_checksum_is_of_the_state_not_its_history():
    a, _ = play("N 1 B L GTC 100 10\nN 2 B L GTC 99 5")
    b, _ = play("N 1 B L GTC 100 10\nN 2 B L GTC 99 5\nN 3 S L GTC 200 1\nC 3")
    assert a.book_checksum() == b.book_checksum() and a.state_checksum() != b.state_checksum()


def check_book(book):
    for side in (f.BUY, f.SELL):
        assert book.prices[side] == sorted(set(book.prices[side])) == sorted(book.levels[side])
        for total, queue in book.levels[side].values():
            assert queue and total == sum(q for q, _ in queue.values()) and all(q > 0 for q, _ in queue.values())
            arrivals = [a for _, a in queue.values()]
            assert arrivals == sorted(arrivals)
    assert len(book.where) == len(book.orders())
    bid, ask = book.best(f.BUY), book.best(f.SELL)
    assert bid is None or ask is None or bid < ask


@pytest.mark.parametrize("seed", [7919 * k for k in range(1, 41)])
def test_invariants_after_every_command(seed):
    book = f.BookFold(INSTRUMENT)
    limits, flow, seq = {}, [0, 0, 0], 0
    for k, c in enumerate(f.generated(seed, 1500)):
        events = f.run(book, [c])
        if len(c) > 1:
            limits[k + 1] = c
        assert events
        for n, e in enumerate(events):
            seq += 1
            assert e[2] == seq and e[1] == k + 1
            assert e[0] != f.TOB or n == len(events) - 1
            if e[0] == f.ACCEPTED:
                flow[0] += e[9]
            elif e[0] == f.TRADE:
                flow[1] += e[9]
                _, side, kind, _, price, _ = limits[e[1]]
                assert kind == f.MARKET or (e[8] <= price if side == f.BUY else e[8] >= price)
            elif e[0] == f.CANCELLED:
                flow[2] += e[9]
        if k % 50 == 0 or k > 1480:
            check_book(book)
            assert flow[0] == 2 * flow[1] + flow[2] + sum(o[3] for o in book.orders())


def test_repetition_prefix_and_sensitivity():
    commands = f.generated(0xC0FFEE, 20_000)
    book = f.BookFold(1)
    events = f.run(book, commands)
    assert len(events) > 20_000 and len(traded(events)) > 1_000
    assert f.run(f.BookFold(1), commands) == events
    commands = f.generated(0xBEEF, 5_000)
    whole, half = f.BookFold(1), f.BookFold(1)
    first = f.run(half, commands[:1667])
    rest = f.BookFold(1)
    assert rest.restore(half.snapshot())
    assert first + f.run(rest, commands[1667:]) == f.run(whole, commands) and rest.state_checksum() == whole.state_checksum()
    commands = f.generated(0xC0FFEE, 2_000)
    k = next(k for k, c in enumerate(commands) if len(c) > 1)
    more = [*commands[:k], (*commands[k][:5], commands[k][5] + 1), *commands[k + 1 :]]
    swapped = [*commands[:10], commands[11], commands[10], *commands[12:]]
    hashes = {f.hash_events(f.run(f.BookFold(1), c)) for c in (commands, more, swapped)}
    assert len(hashes) == 3


def test_a_bad_snapshot_is_refused_and_changes_nothing():
    book, _ = play("N 1 B L GTC 100 10\nN 2 S L GTC 105 3")
    before, good = book.state_checksum(), book.snapshot()
    for orders, instrument in (([(1, 0, 100, 0, 1)], 42), ([(1, 0, 0, 5, 1)], 42), ([(1, 0, 100, 5, 1), (1, 0, 99, 5, 2)], 42), (good.orders, 7)):
        assert not book.restore(f.Snapshot(instrument, 1, 1, 1, good.top, orders))
        assert book.state_checksum() == before
    assert f.BookFold(42).restore(good)


def test_benchmark_stream():
    """The published counts and state: a million commands after a warm-up of a hundred thousand on the same book."""
    from array import array

    g = golden.BENCH
    book, tape = f.BookFold(1), f.Tape(lambda: array("q"))
    f.apply(book, f.generated(g["warm_seed"], g["warm"], swap_pop=True), f.Tape(lambda: array("q")))
    f.apply(book, f.generated(g["seed"], g["commands"], swap_pop=True), tape)
    found = {"events": len(tape), "trades": len(tape.kinds[f.TRADE]) // len(f.FIELDS[f.TRADE]), "resting": len(book.orders()), "state": book.state_checksum()}
    assert found == {k: g[k] for k in found}


MUTANTS = {
    "price of the aggressor": ("traded = -key if other == BUY else key", "traded = price"),
    "last in first out": ("for rid, order in queue.items():", "for rid, order in reversed(queue.items()):"),
    "limit orders cross one tick too far": ("if kind == LIMIT and key > limit:", "if kind == LIMIT and key > limit + 1:"),
    "a snapshot forgets arrivals": ("self.command_seq, self.event_seq, self.arrivals, self.top = s.command_seq, s.event_seq, s.arrivals, tuple(s.top)", "self.command_seq, self.event_seq, self.top = s.command_seq, s.event_seq, tuple(s.top)"),
    "rejects take no sequence": ("if reason:\n", "if reason:\n            self.command_seq -= 1\n"),
    "tops are told every time": ("if top != self.top:", "if True:"),
    "equal quantities leave an empty order": ("if fill == order[0]:", "if fill == order[0] and left:"),
    "fills are not taken from the level": ("                level[0] -= fill\n", ""),
    "the residual of a limit order is dropped": ("if kind == LIMIT and tif == GTC:", "if kind == LIMIT and tif == GTC and quantity == left:"),
    "an empty level stays": ("                del levels[key]\n                del prices[0]\n", "                prices.pop(0)\n"),
    "the top is told without its quantity": ("if top != self.top:", "if top[::2] != self.top[::2]:"),
    "cancels take no sequence": ("        found = self.take(oid)\n        self.event_seq += 1\n", "        found = self.take(oid)\n"),
    "arrivals do not count up": ("self.arrivals += 1", "self.arrivals += 0"),
    "the instrument is not checked": ("if instrument != self.instrument:", "if False:"),
    "market orders may be good till cancelled": ("elif kind == MARKET and tif != IOC:", "elif False:"),
    "ids may be used twice": ("elif oid in self.where:", "elif False:"),
    "unknown cancels are told as cancelled": ("out.kinds[CANCEL_REJECTED].extend((self.command_seq, self.event_seq, oid, UNKNOWN))", "out.kinds[CANCEL_REJECTED].extend((self.command_seq, self.event_seq, oid, DUPLICATE))"),
    "the checksum skips arrivals": ("h = fnv_u64(fnv_u64(fnv_u64(h, oid), quantity), arrival)", "h = fnv_u64(fnv_u64(h, oid), quantity)"),
    "a cancelled order stays in its level's total": ("        level[0] -= quantity\n        if not level[1]:", "        if not level[1]:"),
    "the residual is told with the whole quantity": ("out.kinds[RESTING].extend((cmd, seq, oid, side, price, left))", "out.kinds[RESTING].extend((cmd, seq, oid, side, price, quantity))"),
    "zero quantity is checked late": ("elif quantity == 0:", "elif quantity == 0 and price > 0:"),
}


@pytest.mark.parametrize("name", MUTANTS)
def test_tests_catch_mutants(name):
    """Each mutant differs from the fold on the pinned sample, on rejects, or after a restore."""
    import inspect

    old, new = MUTANTS[name]
    source = inspect.getsource(f)
    assert source.count(old) == 1
    scope: dict = {"__name__": "mutant"}
    exec(compile(source.replace(old, new), "mutant", "exec"), scope)

    def seen(make, run):
        book = make(1)
        out = run(book, golden.commands(golden.SAMPLE)) + run(book, [(50, 0, 0, 0, 0, 0), (51, 0, 0, 0, 90, 5), (51, 0, 0, 0, 90, 5), (52, 0, 1, 0, 0, 5)]) + run(book, [(53, 0, 0, 0, 90, 5)], 9)
        again = make(1)
        again.restore(book.snapshot())
        out += run(again, f.generated(3, 300))
        return out, again.state_checksum()

    assert seen(scope["BookFold"], scope["run"]) != seen(f.BookFold, f.run)
