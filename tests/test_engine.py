"""The engine in Spark: matching, sources, formats, streaming, validators."""

import golden
import pandas as pd
import pytest
from ledgerloom.functions import codes
from ledgerloom.operators import election, fold, log, matching, replication, views
from ledgerloom.plans import derive, invariants, replay
from ledgerloom.sources import binary, orders
from pyspark.sql import functions as F

COLUMNS = [c.split()[0] for c in matching.COMMANDS.split(", ")]


def rows(spark, commands, book=1, start=1):
    out = []
    for k, c in enumerate(commands):
        if len(c) == 1:
            out.append((book, start + k, "C", c[0], None, None, None, None, None, None))
        else:
            out.append((book, start + k, "N", c[0], book, codes.SIDES[c[1]], codes.TYPES[c[2]], codes.TIFS[c[3]], c[4], c[5]))
    return spark.createDataFrame(out, matching.COMMANDS)


@pytest.fixture
def sample(tmp_path):
    path = tmp_path / "orders.txt"
    path.write_text(golden.SAMPLE)
    return str(path)


def test_replay_of_a_file(spark, sample):
    events, depth, summary = replay.replay(spark, sample)
    assert [tuple(r) for r in depth.collect()] == [(1, "BUY", 100, 5, 1)]
    s = summary.first()
    assert (s.commands, s.events) == (17, 49) and (int(s.event_hash), int(s.book_checksum), int(s.state_checksum)) == golden.SAMPLE_HASHES
    book = fold.BookFold(1)
    want = [fold.text_of(e) for e in fold.run(book, golden.commands(golden.SAMPLE))]
    assert [r.text for r in events.orderBy("event_seq").collect()] == want


def test_events_as_files(spark, sample, tmp_path):
    events, _, _ = replay.replay(spark, sample)
    orders.write_events(events, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 49


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_arrow_batches_do_not_matter(spark, batch):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        commands = rows(spark, fold.generated(5, 400)).unionAll(rows(spark, fold.generated(6, 300), book=2))
        got = {r.book: int(r.event_hash) for r in replay.summary(commands).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for book, seed, n in ((1, 5, 400), (2, 6, 300)):
        assert got[book] == fold.hash_events(fold.run(fold.BookFold(book), fold.generated(seed, n)))


def test_spark_text_is_the_folds_text(spark):
    commands = [*fold.generated(11, 500), (900, 0, 0, 0, 0, 5), (901, 0, 0, 0, 10, 0), (902, 0, 1, 0, 0, 5)]
    want = [fold.text_of(e) for e in fold.run(fold.BookFold(1), commands)]
    assert [r.text for r in matching.match(rows(spark, commands)).orderBy("event_seq").collect()] == want


def test_empty_log(spark):
    none = rows(spark, [])
    assert matching.match(none).count() == 0 and matching.snapshots(none).count() == 0


def test_snapshot_continue_and_recover(spark):
    commands = fold.generated(0x7777, 1500)
    whole = matching.snapshots(rows(spark, commands), hashed=True).first()
    state = matching.snapshots(rows(spark, commands[:1000]), hashed=True)
    state = spark.createDataFrame(state.collect(), state.schema)
    overlap = rows(spark, commands[200:], start=201)
    assert overlap.join(state.select("book", "last_seq"), "book").filter("seq > last_seq").count() == 500
    got = matching.recover(state, overlap).first()
    assert (got.last_seq, got.state_checksum, got.orders) == (1500, whole.state_checksum, whole.orders)
    assert [r.valid for r in matching.verified(state).collect()] == [True]
    broken = state.withColumn("arrivals", F.col("arrivals") + 1)
    assert [r.valid for r in matching.verified(broken).collect()] == [False]
    again = matching.snapshots(rows(spark, commands[1000:], start=1001), state, hashed=True).first()
    assert again.event_hash == whole.event_hash


def test_book_from_events_survives_reused_ids(spark):
    text = "N 1 B L GTC 100 5\nC 1\nN 1 B L GTC 100 7\nN 2 S L GTC 100 3\nN 3 S L GTC 105 4\nC 3\nN 3 S L GTC 106 9\nN 4 B L IOC 107 2"
    commands = rows(spark, golden.commands(text))
    events = matching.match(commands)
    got = {(r.side, r.price, r.id, r.quantity) for r in views.book_from_events(events).collect()}
    assert got == {("BUY", 100, 1, 4), ("SELL", 106, 3, 7)}


def test_invariants_find_violations(spark):
    events = matching.match(rows(spark, fold.generated(1, 300)))
    book = matching.book_orders(matching.snapshots(rows(spark, fold.generated(1, 300))))
    commands = rows(spark, fold.generated(1, 300))
    assert invariants.conservation(events, book).count() == 0 and invariants.gapless(events).count() == 0 and invariants.trade_within_limit(events, commands).count() == 0
    lost = events.filter("not (event_type = 'TRADE' and event_seq % 2 = 0)")
    assert invariants.conservation(lost, book).count() == 1 and invariants.gapless(lost).count() > 0
    worse = events.withColumn("price", F.when(F.col("event_type") == "TRADE", F.when(F.col("side") == "BUY", F.lit(20_000)).otherwise(1)).otherwise(F.col("price")))
    assert invariants.trade_within_limit(worse, commands).count() > 0
    crossed = spark.createDataFrame([(1, "BUY", 10), (1, "SELL", 9), (2, "BUY", 8), (2, "SELL", 9)], "book long, side string, price long")
    assert [r.book for r in invariants.uncrossed(crossed).collect()] == [1]
    assert invariants.silent_commands(events.filter("command_seq <> 5"), commands).count() == 1


def test_sweep_of_a_static_book(spark):
    book = spark.createDataFrame([(1, "SELL", p, i, q, i) for i, (p, q) in enumerate([(100, 40), (100, 70), (101, 200), (103, 5)])], "book long, side string, price long, id long, quantity long, arrival long")
    aggressors = spark.createDataFrame([(1, 50, "BUY", "LIMIT", 101, 300), (1, 51, "BUY", "MARKET", 0, 2**62), (1, 52, "BUY", "LIMIT", 99, 5), (1, 53, "SELL", "MARKET", 0, 5), (1, 54, "BUY", "MARKET", 0, 1)], "book long, id long, side string, type string, price long, quantity long")
    got = {}
    for r in views.sweep(book, aggressors).collect():
        got.setdefault(r.aggressor_id, []).append((r.resting_id, r.price, r.quantity))
    assert {k: sorted(v) for k, v in got.items()} == {50: [(0, 100, 40), (1, 100, 70), (2, 101, 190)], 51: [(0, 100, 40), (1, 100, 70), (2, 101, 200), (3, 103, 5)], 54: [(0, 100, 1)]}


def test_percentile_is_floored_rank(spark):
    df = spark.createDataFrame([(v,) for v in range(10)], "v long")
    assert views.percentile_floor(df, "v", 0.99).first().percentile == 8 and views.percentile_floor(df, "v", 0.5).first().percentile == 4


# sources


@pytest.mark.parametrize(
    ("line", "message"),
    [("N 1 BUY LIMIT GTC 100", "expected: N"), ("N 1 buy LIMIT GTC 100 5", "bad side: buy"), ("N 1 BUY X GTC 100 5", "bad type: X"), ("N 1 BUY LIMIT DAY 100 5", "bad time in force: DAY"), ("C", "expected: C"), ("Q 1", "unknown command: Q"), ("N x BUY LIMIT GTC 100 5", "expected: N")],
)
def test_malformed_orders(spark, tmp_path, line, message):
    path = tmp_path / "bad.txt"
    path.write_text(f"# header\nC 1 # fine\n{line}\nalso bad")
    with pytest.raises(orders.MalformedError, match=f"line 3: {message}"):
        orders.read_orders(spark, str(path))


def test_cluster_files(spark, tmp_path):
    path = tmp_path / "cluster"
    path.write_text("# nodes\nnode 1 127.0.0.1 7101\nnode 2 host-b 7102 # second\n")
    nodes = orders.read_nodes(spark, str(path))
    assert [tuple(r) for r in nodes.collect()] == [(1, "127.0.0.1", 7101), (2, "host-b", 7102)]
    assert orders.find(nodes, 2).first().host == "host-b" and orders.others(nodes, 2).first().node_id == 1
    for text, message in (("node 1 a 1\nnode 1 b 2", "line 2: duplicate node id: 1"), ("node 1 a 0", "port out of range"), ("node 1 a 70000", "port out of range"), ("peer 1 a 2", "unknown directive: peer"), ("node 1 a", "expected: node"), ("# none", "lists no nodes")):
        path.write_text(text)
        with pytest.raises(orders.MalformedError, match=message):
            orders.read_nodes(spark, str(path))


# formats


def entry(seq, term=1):
    return binary.encode_entry(seq, term, {"kind": "N", "id": seq, "instrument": 1, "side": "SELL", "type": "LIMIT", "tif": "GTC", "price": -5, "quantity": 2**62 - 1})


def test_entries_and_write_ahead_files():
    assert binary.decode_entry(entry(3, 2))["price"] == -5
    for bad in (entry(3)[:-1], entry(3) + b"x", entry(3)[:16] + b"\x07", entry(3)[:29] + b"\x02" + entry(3)[30:]):
        with pytest.raises(binary.Damaged):
            binary.decode_entry(bad)
    data = b"".join(binary.wal_record(k, entry(k)) for k in range(1, 11))
    records, good = binary.wal_records(data + data[:16])
    assert len(records) == 10 and len(data) == good
    broken = bytearray(data)
    broken[2 * len(data) // 10 + 20] ^= 1
    assert len(binary.wal_records(bytes(broken))[0]) == 2
    for cut in range(len(data)):
        assert len(binary.wal_records(data[:cut])[0]) == cut // (len(data) // 10)
    assert [s for s, _ in binary.wal_records(binary.wal_through(data, 7))[0]] == [8, 9, 10]


def test_snapshot_and_vote_files():
    book = fold.BookFold(1)
    fold.run(book, fold.generated(0x5A5A, 2000))
    body = binary.encode_snapshot(book.snapshot(), 2000, 3, book.state_checksum())
    snap, seq, term, checksum = binary.open_snapshot_file(binary.snapshot_file(body))
    again = fold.BookFold(1)
    assert again.restore(snap) and (seq, term, checksum) == (2000, 3, again.state_checksum())
    assert fold.run(again, fold.generated(0xB00B, 500)) == fold.run(book, fold.generated(0xB00B, 500))
    for bad in (binary.snapshot_file(body)[:-1], binary.snapshot_file(body[:-1] + b"\x00"), b""):
        with pytest.raises(binary.Damaged):
            binary.open_snapshot_file(bad if bad[:4] != body[:4] or len(bad) < len(body) else bad[:-5] + b"\x01" + bad[-4:])
    assert binary.open_vote_file(binary.vote_file(7, 3)) == (7, 3, False)
    assert binary.open_vote_file(binary.vote_file(7, 3)[:-1]) == (0, 0, True) and binary.open_vote_file(b"\x00" * 20) == (0, 0, True)


MESSAGES = [
    ("HELLO", {"node_id": 1, "version": 1, "address": "a:1"}), ("HEARTBEAT", {"node_id": 1, "counter": 2**63}), ("EVENT_ACK", {"node_id": 1, "through_event_seq": 5, "state_checksum": 2**64 - 1}),
    ("REQUEST_VOTE", {"term": 1, "candidate_id": 2, "last_log_seq": 3}), ("VOTE_RESPONSE", {"term": 1, "voter_id": 2, "granted": 1}),
    ("APPEND_RESPONSE", {"term": 1, "node_id": 2, "last_log_seq": 3, "ok": 1, "last_applied": 4, "state_checksum": 5}), ("COMMAND_FORWARD", {"node_id": 1, "origin_seq": 2, "command": {"kind": "C", "id": 9}}),
    ("APPEND_ENTRIES", {"term": 1, "leader_id": 2, "prev_seq": 3, "prev_term": 1, "commit_seq": 2, "entries": [{"seq": 4, "term": 1, "kind": "C", "id": 9}]}),
]


class Reader:
    """Takes the place of a DataFrame of files: what a reader would run on each part."""

    def __init__(self, spark):
        self.sparkSession = spark

    def select(self, *_):
        return self

    def mapInPandas(self, run, schema):
        return run


def test_small_files_share_frames(spark):
    n = 25_000
    part = pd.DataFrame({"path": [str(k) for k in range(n)], "content": [binary.vote_file(k, k % 6)[: 19 + (k % 7 > 0)] for k in range(n)]})
    frames = list(binary.read_votes(Reader(spark))(iter([part])))
    assert len(frames) == 3
    got = pd.concat(frames, ignore_index=True)
    assert got["path"].tolist() == part["path"].tolist() and got["damaged"].tolist() == [k % 7 == 0 for k in range(n)]
    assert got["term"].tolist() == [k if k % 7 else 0 for k in range(n)] and got["voted_for"].tolist() == [k % 6 if k % 7 else 0 for k in range(n)]


def test_long_stream(spark):
    n = 25_000
    messages = spark.range(n).selectExpr(
        "'a' as path", f"{n} - 1 - id as msg_no", "2 as code", f"({n} - 1 - id) % 5 as n", f"{n} - id as seq", "'C' as kind", "7L as id", "0L as instrument",
        "cast(null as string) as side", "cast(null as string) as type", "cast(null as string) as tif", "cast(null as long) as price", "cast(null as long) as quantity",
    )
    files = binary.frame_files(messages, 3)
    # appending frame after frame would copy the stream for each
    assert "aggregate(" not in files._jdf.queryExecution().optimizedPlan().toString().lower().replace("hashaggregate(", "")
    content = bytes(files.first().content)
    assert content == b"".join(binary.encode_message("HEARTBEAT", {"node_id": k % 5, "counter": k + 1}) for k in range(n))[:-3]
    frames = list(binary.read_frames(Reader(spark))(iter([pd.DataFrame({"path": ["a"], "content": [content]})])))
    assert [len(f) for f in frames] == [10_000, 10_000, 5_000]
    got = pd.concat(frames, ignore_index=True)
    assert got["msg_no"].tolist() == list(range(n)) and got["error"].tolist() == [None] * (n - 1) + ["CUT_OFF"] and got["n_bytes"].tolist() == [24] * (n - 1) + [21]


@pytest.mark.parametrize("size", [1, 3, 11, 12, 13, 1000])
def test_frames_in_chunks(size):
    stream = b"".join(binary.encode_message(k, m) for k, m in MESSAGES)
    frames, got = binary.Frames(), []
    for at in range(0, len(stream), size):
        got += [binary.decode_message(c, b) for c, b in frames.add(stream[at : at + size])]
    assert got == MESSAGES and not frames.held


def test_bad_frames():
    for kind, m in MESSAGES:
        frame = binary.encode_message(kind, m)
        code, body = next(k for k, v in binary.MESSAGES.items() if v == kind), frame[12:]
        for bad in [body[:k] for k in range(len(body))] + [body + b"x"]:
            with pytest.raises(binary.Damaged):
                binary.decode_message(code, bad)
    for head, failure in ((b"XXXX\x01\x00\x01\x00\x00\x00\x00\x00", "BAD_MAGIC"), (binary.FRAME_HEADER.pack(binary.FRAME_MAGIC, 2, 1, 0), "BAD_VERSION"), (binary.FRAME_HEADER.pack(binary.FRAME_MAGIC, 1, 1, 2**21), "PAYLOAD_TOO_LARGE")):
        frames = binary.Frames()
        assert not list(frames.add(head)) and frames.failure == failure and not list(frames.add(binary.encode_message(*MESSAGES[1])))


def test_captured_frames(spark):
    stream = b"".join(binary.encode_message(k, m) for k, m in MESSAGES)
    files = spark.createDataFrame([("a", bytearray(stream)), ("b", bytearray(stream[:-1]))], "path string, content binary")
    got = binary.read_frames(files).orderBy("path", "msg_no").collect()
    assert [r.kind for r in got[:8]] == [k for k, _ in MESSAGES] and got[7].entries == 1 and got[-1].error == "CUT_OFF"


def test_little_endian_column(spark):
    df = spark.createDataFrame([(bytearray((2**40 + 77).to_bytes(8, "little")),)], "b binary")
    assert df.select(codes.little_endian(F.col("b"), 1, 8).alias("v")).first().v == 2**40 + 77


# validators


def test_command_log(spark):
    offered = spark.createDataFrame([(1, 1, 1), (1, 3, 2), (1, 1, 3), (1, 2, 4)], "node_id long, seq long, arrival long")
    assert [r.accepted for r in log.accepted(offered).orderBy("arrival").collect()] == [True, False, False, True]
    three = spark.createDataFrame([(1, k, 1) for k in (1, 2, 3)], "node_id long, seq long, term long")
    kept, boundary = log.with_boundary(three, 2, 1)
    assert log.entries(kept, 1, 10).count() == 0 and log.entries(three, 2, 10).count() == 2
    assert [log.can_serve(kept, k).first().can_serve for k in (1, 3, 4, 5)] == [False, True, True, False]
    wanted = spark.createDataFrame([(1, k) for k in (0, 1, 2, 3, 4)], "node_id long, seq long")
    assert [r.term for r in log.term_at(kept, wanted, boundary).orderBy("seq").collect()] == [0, None, 1, 1, None]
    gone = log.bounds(kept.limit(0), boundary).first()
    assert (gone.first_seq, gone.last_seq, gone.size) == (3, 2, 0) and log.cleared(three).count() == 0
    assert [r.seq for r in log.appended(three.drop("seq"), "term", after=7).orderBy("seq").collect()] == [8, 9, 10]


def test_a_majority_of_the_leaders_own_term_commits(spark):
    def commit(log_rows, matched, nodes, at=0):
        held = spark.createDataFrame([(1, s, t) for s, t in log_rows], "node_id long, seq long, term long")
        acks = spark.createDataFrame([(k, n, 5, True, m, m, 0) for k, (n, m) in enumerate(matched)], "msg_no long, follower_id long, term long, ok boolean, match_seq long, last_applied long, state_checksum long")
        # the leader's term is that of its newest entry here
        return replication.majority_commit(held, acks, 1, nodes, at).first()

    old = [(1, 2), (2, 2), (3, 2), (4, 5)]
    assert commit(old, [(2, 3), (3, 3)], 3).commit_seq == 0  # an older term's entry never commits by count
    assert commit(old, [(2, 4), (3, 4)], 3).commit_seq == 4
    assert commit([(k, 1) for k in range(1, 2401)], [(2, 800)], 2, 800).commit_seq == 800
    assert commit([(k, 1) for k in range(1, 11)], [(2, 7)], 5).commit_seq == 0  # nodes that are not heard of count as 0
    assert commit([(k, 1) for k in range(1, 11)], [(2, 7), (3, 5)], 5).commit_seq == 5


def test_negative_answers_move_no_match_point(spark):
    acks = spark.createDataFrame([(1, 2, 1, True, 9, 9, 0), (2, 2, 1, False, 4, 3, 0), (3, 3, 1, False, 4, 4, 0)], "msg_no long, follower_id long, term long, ok boolean, match_seq long, last_applied long, state_checksum long")
    assert [(r.match_seq, r.last_applied) for r in replication.latest_acks(acks).orderBy("follower_id").collect()] == [(9, 3), (0, 4)]


def test_votes(spark):
    requests = spark.createDataFrame([(1, 5, 1, 10, 7, 7), (2, 5, 1, 11, 9, 7), (3, 5, 1, 10, 7, 7), (4, 4, 1, 12, 9, 7), (5, 6, 1, 11, 6, 7), (6, 6, 1, 12, 7, 7), (7, 5, 2, 10, 7, 7)], "arrival long, term long, voter_id long, candidate_id long, candidate_seq long, voter_seq long")
    answered = election.answers(requests)
    assert [r.answer for r in answered.orderBy("arrival").collect()] == ["GRANTED", "ALREADY_VOTED", "GRANTED", "STALE_TERM", "STALE_LOG", "GRANTED", "GRANTED"]
    assert {(r.term, r.candidate_id): (r.votes, r.won) for r in election.tally(answered, 3).collect()} == {(5, 10): (2, True), (6, 12): (1, False)}
    leaders = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (2, 3)], "term long, leader long")
    assert [r.term for r in election.split_brain(leaders).collect()] == [2] and election.highest(leaders).count() == 2
    assert all(150 <= t <= 300 for t in election.timeouts(1, 50))


def test_divergence(spark):
    acks = spark.createDataFrame([(1, 2, 1, True, 5, 5, 77), (2, 3, 1, True, 5, 5, 77), (3, 2, 1, True, 6, 6, 1), (4, 3, 1, True, 6, 6, 2)], "msg_no long, follower_id long, term long, ok boolean, match_seq long, last_applied long, state_checksum long")
    assert [r.last_applied for r in replication.divergences(acks).collect()] == [6]


# streaming


def test_stream_with_gaps_duplicates_and_restart(spark, tmp_path):
    from ledgerloom.streaming import live

    commands = rows(spark, fold.generated(9, 300)).unionAll(rows(spark, fold.generated(10, 200), book=2))
    source, out, at = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))

    def feed(part, k):
        part.coalesce(1).write.parquet(f"{source}/part={k}")
        stream = spark.readStream.schema(commands.schema).parquet(f"{source}/part=*")
        live.write_stream(live.match_stream(stream), out, at).awaitTermination()

    feed(commands.filter("seq <= 100 and seq <> 50"), 0)  # stops at the gap
    assert spark.read.parquet(out).agg(F.max("command_seq")).first()[0] == 49
    feed(commands.filter("seq between 40 and 120"), 1)  # closes it, with duplicates
    assert spark.read.parquet(out).agg(F.max("command_seq")).first()[0] == 120
    feed(commands.filter("seq > 110"), 2)
    got = spark.read.parquet(out).select("book", "event_seq", "text")
    assert invariants.differences(got, matching.match(commands).select("book", "event_seq", "text")).count() == 0


def test_stream_from_snapshots(spark, tmp_path):
    from ledgerloom.streaming import live

    commands = fold.generated(12, 400)
    state = live.snapshot_bytes(matching.snapshots(rows(spark, commands[:250])))
    rows(spark, commands[250:], start=251).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(matching.COMMANDS).parquet(str(tmp_path / "in"))
    live.write_stream(live.match_stream(stream, state), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    got = [r.text for r in spark.read.parquet(str(tmp_path / "out")).orderBy("event_seq").collect()]
    want = [fold.text_of(e) for e in fold.run(fold.BookFold(1), commands)]
    assert got == want[-len(got) :] and len(got) > 300


# registry


def test_derived_flow_has_every_kind(spark, sf_dir):
    commands = derive.commands(spark, sf_dir)
    assert commands.filter("kind = 'C'").count() > 0 and commands.select("type", "tif").distinct().count() >= 4


def test_queries_match_their_sql(spark, sf_dir):
    import glob
    import os

    import duckdb
    from ledgerloom import registry

    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    sql = registry.oracle_sql()
    for name, query in registry.queries().items():
        if name == "stream_matches_batch":
            continue
        df = query(spark, sf_dir)
        if name not in sql:
            assert df.count() > 0, name
            continue
        cols = sorted(df.columns)
        key = lambda row: tuple((v is None, str(v)) for v in row)
        got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key)
        want = con.sql(sql[name])
        place = [want.columns.index(c) for c in cols]
        assert len(want.columns) == len(cols), name
        assert got == sorted((tuple(r[k] for k in place) for r in want.fetchall()), key=key), name


def test_entry_point(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def cluster(seed: int, nodes: int, until: int, loss: float, crashes: bool):
    """A cluster of Member folds with lossy, slow links; returns (term, leader) claims and the inbox of each node."""
    import heapq

    rnd = fold.Lcg(seed)
    members = {k: election.Member(k, [n for n in range(1, nodes + 1) if n != k], seed * 1000 + k) for k in range(1, nodes + 1)}
    queue, claims, inbox, n, down = [], [], [], 0, {}
    reply = {"REQUEST_VOTE": "REQUEST_VOTE", "VOTE": "VOTE", "HEARTBEAT": "APPEND"}
    for at in range(0, until, 10):
        for k in members:
            n += 1
            heapq.heappush(queue, (at, n, k, ("TICK", None, None, None, None)))
        if crashes and rnd.within(0, 99) < 2:
            down[rnd.within(1, nodes)] = at + rnd.within(100, 800)
        while queue and queue[0][0] <= at:
            now, _, k, message = heapq.heappop(queue)
            if down.get(k, 0) > now:
                continue
            inbox.append((k, len(inbox), now, *message))
            for kind, to, term, log_seq, granted in members[k].step(now, *message):
                if kind == "BECAME_LEADER":
                    claims.append((term, k))
                elif kind in reply and rnd.within(0, 999) >= loss * 1000:
                    n += 1
                    heapq.heappush(queue, (now + rnd.within(1, 40), n, to, (reply[kind], term, k, granted, log_seq)))
    return claims, inbox


@pytest.mark.parametrize("seed", range(1, 26))
def test_no_term_has_two_leaders(seed):
    nodes = (3, 5, 7)[seed % 3]
    claims, _ = cluster(seed, nodes, 6000, 0.2 * (seed % 2), crashes=seed % 4 > 1)
    assert claims and len({t for t, _ in claims}) == len({*claims})


def test_members_in_spark_are_members_alone(spark):
    claims, inbox = cluster(4, 5, 3000, 0.1, crashes=True)
    rows = spark.createDataFrame(inbox, "node_id long, ordinal long, at long, kind string, term long, peer long, granted boolean, log_seq long")
    got = election.actions(rows, [1, 2, 3, 4, 5], seed=4)
    leaders = got.filter("action = 'BECAME_LEADER'").select("term", F.col("node_id").alias("leader"))
    assert sorted(tuple(r) for r in leaders.collect()) == sorted(claims) and election.split_brain(leaders).count() == 0


def test_rules_of_an_election():
    m = election.Member(1, [2, 3], 9)
    assert m.step(10, "TICK") == [] and m.step(301, "TICK") == [("REQUEST_VOTE", 2, 1, 0, None), ("REQUEST_VOTE", 3, 1, 0, None)]
    assert m.step(302, "VOTE", 1, 2, False, None) == [] and m.role == "CANDIDATE"
    assert m.step(303, "VOTE", 1, 2, True, None)[0][0] == "BECAME_LEADER" and m.step(304, "VOTE", 1, 3, True, None) == []
    assert m.step(340, "TICK") == [] and len(m.step(353, "TICK")) == 2  # heartbeats
    assert m.step(360, "APPEND", 0, 2, None, None) == [] and m.role == "LEADER"
    assert m.step(361, "APPEND_RESPONSE", 4, 2, None, None) == [("STEPPED_DOWN", 1, 4, None, None)]
    assert m.step(362, "REQUEST_VOTE", 4, 2, None, 0) == [("VOTE", 2, 4, None, True)] and m.step(363, "REQUEST_VOTE", 4, 3, None, 9) == [("VOTE", 3, 4, None, False)]
    m.step(364, "LOG", None, None, None, 7)
    assert m.step(365, "REQUEST_VOTE", 5, 3, None, 6) == [("VOTE", 3, 5, None, False)] and m.term == 5 and m.vote is None
    assert m.step(366, "REQUEST_VOTE", 4, 3, None, 9) == [("VOTE", 3, 5, None, False)]
    m.step(367, "RESET")
    assert (m.term, m.vote, m.role) == (0, None, "FOLLOWER")
    assert election.Member(1, [], 1).step(400, "TICK")[0][0] == "BECAME_LEADER"


def test_command_line(spark, sample, capsys, monkeypatch, tmp_path):
    import io

    assert replay.main([sample]) == 0
    out = capsys.readouterr().out.splitlines()
    assert out[0].startswith("seq=1 cmd=1 ACCEPTED") and "  100 x5 (1 orders)" in out and out[-5:-2] == ["commands=17", "events=49", f"event_hash={golden.SAMPLE_HASHES[0]}"]
    monkeypatch.setattr("sys.stdin", io.StringIO("N 1 BUY LIMIT GTC 100 1\n"))
    assert replay.main(["--quiet", "--instrument", "7", "-"]) == 0 and len(capsys.readouterr().out.splitlines()) == 5
    (tmp_path / "bad").write_text("X 1")
    assert replay.main([str(tmp_path / "bad")]) == 1 and "line 1: unknown command: X" in capsys.readouterr().err
    assert replay.main([]) == 2


def test_generated_commands(spark):
    got = matching.snapshots(orders.generated(spark, 77, 500), hashed=True).first()
    assert int(got.event_hash) == fold.hash_events(fold.run(fold.BookFold(1), fold.generated(77, 500)))
