"""Registry of the engine's own queries and of their DuckDB SQL.

The fold has SQL of its own (plans/fold_sql.py), a recursive query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import codes
from ledgerloom.operators import election, log, matching, replication, views
from ledgerloom.plans import derive, fold_sql, invariants, replay
from ledgerloom.sources import binary, orders
from ledgerloom.store import new_path, written

LEADER, NODES = 1, 5
#: Where a prefix of a book's commands ends, as parts of them: a quarter, a half.
QUARTER, HALF = 4, 2


def _static(spark: SparkSession, d: str) -> DataFrame:
    return views.static_book(derive.commands(spark, d))


def _aggressors(spark: SparkSession, d: str) -> DataFrame:
    return derive.commands(spark, d).filter((codes.stateless_reason() == "NONE") & (F.col("tif") == "IOC"))


def _match(spark: SparkSession, d: str, text: bool = False) -> DataFrame:
    return matching.match(derive.commands(spark, d), text=text)


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return matching.book_orders(matching.snapshots(derive.commands(spark, d)))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    return election.answers(derive.votes(spark, d))


def _leaders(spark: SparkSession, d: str) -> DataFrame:
    """Every candidate with two votes or more claims to lead: enough for claims to collide."""
    return election.tally(_answers(spark, d), NODES).filter("votes >= 2").select("term", F.col("candidate_id").alias("leader"))


def parse_orders(spark: SparkSession, d: str) -> DataFrame:
    lines = derive.commands(spark, d).select("book", F.col("seq").alias("line_no"), F.concat(orders.order_line(), F.lit("  # flow")).alias("value"))
    return orders.parsed_lines(lines).filter("error is null").select("book", F.col("line_no").alias("seq"), "kind", "id", "side", "type", "tif", "price", "quantity")


def validate_stateless(spark: SparkSession, d: str) -> DataFrame:
    return derive.commands(spark, d).select("book", "seq", codes.stateless_reason().alias("reason"))


def command_mix(spark: SparkSession, d: str) -> DataFrame:
    return derive.commands(spark, d).groupBy("kind", "type", "tif").agg(F.count("*").alias("commands"), F.coalesce(F.sum("quantity"), F.lit(0)).cast("long").alias("quantity"))


def enum_names(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    side = codes.name_of(e % 3, codes.SIDES)
    return derive.events(spark, d).select("event_id", side.alias("side"), codes.opposite(side).alias("opposite"), codes.name_of(e % 9, codes.REASONS).alias("reason"), codes.code_of(codes.name_of(e % 9, codes.REASONS), codes.REASONS).cast("long").alias("reason_code"), codes.decoded(e % 4, codes.TIFS).alias("tif"))


def log_accepted(spark: SparkSession, d: str) -> DataFrame:
    """Entries offered in the order of arrival: every hundredth comes twice, every thousandth of node 3 is missing at first."""
    one = derive.log(spark, d).select("node_id", "seq", F.col("seq").alias("arrival")).filter("not (node_id = 3 and seq % 1000 = 0)")
    return log.accepted(one.withColumn("arrival", F.col("arrival") * 2).unionAll(one.filter("seq % 100 = 0").select("node_id", "seq", (F.col("seq") * 2 + 1).alias("arrival"))))


def log_term_at(spark: SparkSession, d: str) -> DataFrame:
    """The term at every sequence of every node, at 0 and at one beyond the end."""
    whole = derive.log(spark, d)
    kept, boundary = log.with_boundary(whole, 100, 1)
    ends = whole.groupBy("node_id").agg(F.max("seq").alias("n"))
    return log.term_at(kept, ends.select("node_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") + 1)).alias("seq")), boundary)


def log_cleared(spark: SparkSession, d: str) -> DataFrame:
    """What is known of logs after they were cleared: no entries, and the snapshot boundary that they had."""
    kept, boundary = log.with_boundary(derive.log(spark, d), 100, 1)
    return log.bounds(log.cleared(kept), boundary)


def log_bounds(spark: SparkSession, d: str) -> DataFrame:
    return log.bounds(*log.with_boundary(derive.log(spark, d), 100, 1))


def submit_status(spark: SparkSession, d: str) -> DataFrame:
    e, v = F.col("event_id"), F.floor("value").cast("long")
    rows = derive.events(spark, d).select("event_id", (e % 10 != 0).alias("is_primary"), (e % 2 == 0).alias("synchronous"), (e % 7).alias("backups"), (e + v % 12).alias("last_seq"), e.alias("commit_seq"), (e % 11 == 0).alias("saturated"))
    return replication.submit_status(rows, 8).select("event_id", "status")


def _prefix(commands: DataFrame, part: int) -> DataFrame:
    """The first 1 / part of each book's commands."""
    ends = commands.groupBy("book").agg(F.floor(F.max("seq") / part).alias("end"))
    return commands.join(ends, "book").filter("seq <= end").drop("end")


def _after(commands: DataFrame, part: int) -> DataFrame:
    ends = commands.groupBy("book").agg(F.floor(F.max("seq") / part).alias("end"))
    return commands.join(ends, "book").filter("seq > end").drop("end")


def snapshot_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The state of every book after its snapshot went through a file: encoded, read, restored and summed up anew."""
    from ledgerloom.streaming import live

    states = written(matching.snapshots(derive.commands(spark, d)), "snapshot")
    files = live.snapshot_bytes(states).select(F.col("book").cast("string").alias("path"), F.concat("content", codes.crc_bytes(F.col("content"))).alias("content"))
    return binary.read_snapshots(files).filter("error is null").select(F.col("path").cast("long").alias("book"), "last_seq", "command_seq", "event_seq", "arrivals", "orders", "quantity", "book_checksum", "state_checksum")


def prefix_replay(spark: SparkSession, d: str) -> DataFrame:
    """The events after the first half of each book's commands, from the snapshot of the first half."""
    commands = derive.commands(spark, d)
    state = written(matching.snapshots(_prefix(commands, HALF)), "snapshot")
    return matching.match(_after(commands, HALF), state).select("book", "event_seq", "command_seq", "text")


def recovery_as_of(spark: SparkSession, d: str) -> DataFrame:
    """The state of each book from a snapshot at its half and a log that begins at its quarter: the two overlap."""
    commands = derive.commands(spark, d)
    state = written(matching.snapshots(_prefix(commands, HALF)), "snapshot")
    again = matching.recover(state, _after(commands, QUARTER))
    return again.select("book", F.col("command_seq").alias("commands"), F.col("event_seq").alias("events"), *[F.col(c).cast("string").alias(c) for c in ("book_checksum", "state_checksum")])


def recovery_report(spark: SparkSession, d: str) -> DataFrame:
    """What a recovery does if the log lacks every 150th command beyond the snapshot at a quarter; odd books have none."""
    commands = derive.commands(spark, d)
    state = matching.snapshots(_prefix(commands, QUARTER).filter("book % 2 = 0"))
    return matching.recovery_report(state, commands.filter("seq % 150 <> 0"))


def book_from_events(spark: SparkSession, d: str) -> DataFrame:
    """The resting orders of all books, rebuilt from their events alone."""
    return views.rests_in_order(views.book_from_events(_match(spark, d)), "rested_at").select("book", "side", "price", "id", "quantity", F.col("queue_pos").cast("long").alias("queue_pos"))


def stream_matches_batch(spark: SparkSession, d: str) -> DataFrame:
    """The event lines of a stream that gets the commands in three files, out of order and with repetitions."""
    from ledgerloom.streaming import live

    at = new_path(spark, "stream")
    commands = derive.commands(spark, d)
    late = F.col("seq") % 3
    for k, part in enumerate((commands.filter(late == 1), commands.filter(late != 1), commands.filter(late == 2))):
        part.write.parquet(f"{at}/in/part={k}")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.ROCKSDB)
    try:
        rows = spark.readStream.schema(commands.schema).option("maxFilesPerTrigger", 16).parquet(f"{at}/in/part=*")
        live.write_stream(live.match_stream(rows), f"{at}/out", f"{at}/checkpoint").awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before) if before else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return spark.read.parquet(f"{at}/out").select("book", "event_seq", "text")


def replay_files(spark: SparkSession, d: str) -> DataFrame:
    """The report's numbers for order files, one a book, that were written as text, read and replayed."""
    at = new_path(spark, "orders")
    orders.write_orders(derive.commands(spark, d), at)
    return replay.summary(orders.read_order_files(spark, at)).withColumns({c: F.col(c).cast("string") for c in ("event_hash", "book_checksum", "state_checksum")})


def event_files(spark: SparkSession, d: str) -> DataFrame:
    """The lines of event files, one a book, as they are read back."""
    at = new_path(spark, "lines")
    orders.write_events(_match(spark, d, text=True), at)
    return spark.read.text(at).select(F.col("book").cast("long").alias("book"), F.col("value").alias("text"))


def malformed_orders(spark: SparkSession, d: str) -> DataFrame:
    """The malformed lines of order files: every eleventh line is damaged in one of six ways."""
    return orders.parsed_lines(derive.order_lines(spark, d)).filter("error is not null").select("file", "line_no", "error")


def cluster_nodes(spark: SparkSession, d: str) -> DataFrame:
    """What lines of cluster files say, or what is wrong with them."""
    return orders.parsed_nodes(derive.node_lines(spark, d))


def cluster_others(spark: SparkSession, d: str) -> DataFrame:
    """The nodes of each cluster file but node 3, and whether node 3 is there."""
    nodes = orders.parsed_nodes(derive.node_lines(spark, d)).filter("error is null")
    return orders.others(nodes, 3).join(orders.find(nodes, 3).select("file", F.lit(True).alias("has_3")), "file", "left").select("file", "node_id", "host", "port", F.coalesce("has_3", F.lit(False)).alias("has_3"))


def vote_files(spark: SparkSession, d: str) -> DataFrame:
    """Term and vote of files of which every seventh is damaged and every eleventh cut off."""
    return binary.read_votes(binary.vote_files(derive.ballots(spark, d))).select(F.col("path").cast("long").alias("event_id"), "term", "voted_for", "damaged")


def wal_truncated(spark: SparkSession, d: str) -> DataFrame:
    """Write-ahead files without the records through half of each; those of odd books are reset."""
    commands = derive.commands(spark, d)
    files = binary.wal_bytes(commands.withColumn("term", F.lit(1).cast("long")))
    ends = commands.groupBy(F.col("book").cast("string").alias("path")).agg(F.floor(F.max("seq") / HALF).alias("through"))
    cut = binary.truncated_wal(files.join(ends, "path"), "through")
    left = cut.select("path", F.when(F.col("path").cast("long") % 2 == 1, F.lit(b"")).otherwise(F.col("content")).alias("content"))
    return binary.wal_report(left).select(F.col("path").cast("long").alias("book"), "records", "good_bytes", "torn_bytes")


def wal_headers(spark: SparkSession, d: str) -> DataFrame:
    """The numbers of each file's first header, read by column expressions."""
    number = lambda at: codes.little_endian(F.col("content"), at, 4)
    return binary.wal_bytes(derive.commands(spark, d).withColumn("term", F.lit(1).cast("long"))).select(F.col("path").cast("long").alias("book"), number(1).alias("magic"), number(5).alias("seq"), number(9).alias("size"))


def captured_messages(spark: SparkSession, d: str) -> DataFrame:
    """The messages of one byte stream a book, whose end is cut off: a message of each kind in turn."""
    return binary.read_frames(binary.frame_files(derive.wire(spark, d), 5)).select(F.col("path").cast("long").alias("book"), "msg_no", "n_bytes", "kind", "entries", "error")


def generated_flow(spark: SparkSession, d: str) -> DataFrame:
    """The generator's streams of two seeds, a thousand commands each: a sequence of numbers, no table."""
    return orders.generated(spark, 7, 1000, 1).unionAll(orders.generated(spark, 0xC0FFEE, 1000, 2))


def reduced_orders(spark: SparkSession, d: str) -> DataFrame:
    """Static books after every cancel took one unit, or all of an order of one, from the order that it names."""
    return views.reduced(_static(spark, d), derive.commands(spark, d).filter("kind = 'C'").select("book", "id", F.lit(1).cast("long").alias("by")))


def member_actions(spark: SparkSession, d: str) -> DataFrame:
    """What five members of a cluster do on an inbox of ticks, votes, appends, heads and crashes."""
    return election.actions(derive.inbox(spark, d), [1, 2, 3, 4, 5])


def wal_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The command log after it was written to write-ahead files, one a book, and read from them."""
    rows = derive.commands(spark, d).withColumn("term", F.floor((F.col("seq") - 1) / 100).cast("long") + 1)
    return binary.read_wal(binary.wal_bytes(rows)).select(F.col("path").cast("long").alias("book"), "seq", "term", "kind", "id", "instrument", "side", "type", "tif", "price", "quantity")


def wal_torn_tail(spark: SparkSession, d: str) -> DataFrame:
    """Records and torn bytes of write-ahead files that lost their last seven bytes."""
    files = binary.wal_bytes(derive.commands(spark, d).withColumn("term", F.lit(1).cast("long")))
    return binary.wal_report(files.select("path", F.expr("substring(content, 1, length(content) - 7)").alias("content"))).select(F.col("path").cast("long").alias("book"), "records", "torn_bytes")


def crc32_payload(spark: SparkSession, d: str) -> DataFrame:
    return derive.commands(spark, d).select("book", "seq", F.crc32(orders.order_line().cast("binary")).alias("crc"))


def nth_event_of_type(spark: SparkSession, d: str) -> DataFrame:
    return views.nth(_match(spark, d), "TRADE", 3).select("book", "event_seq", "command_seq", "id", "resting_id", "price", "quantity")


def percentile_floor(spark: SparkSession, d: str) -> DataFrame:
    return views.percentile_floor(derive.commands(spark, d).filter("kind = 'N'"), "quantity", 0.99, "book")


def amplification_ratios(spark: SparkSession, d: str) -> DataFrame:
    return replication.amplification(derive.messages(spark, d), derive.commands(spark, d))


def final_book(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d)


def checksums(spark: SparkSession, d: str) -> DataFrame:
    """64-bit values as text, as other engines' decimals differ."""
    return replay.summary(derive.commands(spark, d)).withColumns({c: F.col(c).cast("string") for c in ("event_hash", "book_checksum", "state_checksum")})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    functions = (
        log_cleared, recovery_report, replay_files, event_files, malformed_orders, cluster_nodes, cluster_others, vote_files, wal_truncated, wal_headers, captured_messages, generated_flow, reduced_orders, member_actions,
        parse_orders, validate_stateless, command_mix, enum_names, log_accepted, log_term_at, log_bounds, submit_status, snapshot_roundtrip, prefix_replay, recovery_as_of,
        book_from_events, stream_matches_batch, wal_roundtrip, wal_torn_tail, crc32_payload, nth_event_of_type, percentile_floor, amplification_ratios, final_book, checksums,
    )
    return {f.__name__: f for f in functions} | {
        "derived_commands": derive.commands,
        "static_book_depth": lambda s, d: views.depth(_static(s, d)),
        "static_top_of_book": lambda s, d: views.top_of_book(_static(s, d)),
        "static_quantity_at": lambda s, d: views.quantity_at(_static(s, d), "BUY", 107),
        "static_order_counts": lambda s, d: views.order_counts(_static(s, d)),
        "static_front_level": lambda s, d: views.front_level(_static(s, d)).select("book", "side", "price", "id", "quantity"),
        "static_contains": lambda s, d: derive.commands(s, d).filter("kind = 'C'").join(_static(s, d).select("book", "id"), ["book", "id"], "left_semi").select("book", "seq", "id"),
        "book_order_walk": lambda s, d: views.walk(_static(s, d)),
        "crossing_pairs": lambda s, d: views.crossing_levels(_static(s, d)),
        "sweep_single_aggressor": lambda s, d: views.sweep(_static(s, d), _aggressors(s, d)),
        "match_events": lambda s, d: _match(s, d, text=True),
        "events_by_type": lambda s, d: views.by_type(_match(s, d)),
        "trades": lambda s, d: views.trades(_match(s, d)),
        "tob_changes": lambda s, d: views.tob_changes(_match(s, d)),
        "quotes_at_trades": lambda s, d: views.quotes_at_trades(_match(s, d)),
        "bars": lambda s, d: views.bars(_match(s, d), 100),
        "final_depth": lambda s, d: views.depth(_orders(s, d)),
        "conservation": lambda s, d: invariants.conservation(_match(s, d), _orders(s, d)),
        "uncrossed_book": lambda s, d: invariants.uncrossed(_orders(s, d)),
        "queue_order": lambda s, d: invariants.queue_order(_orders(s, d)),
        "trade_within_limit": lambda s, d: invariants.trade_within_limit(_match(s, d), derive.commands(s, d)),
        "gapless_events": lambda s, d: invariants.gapless(_match(s, d)),
        "silent_commands": lambda s, d: invariants.silent_commands(_match(s, d), derive.commands(s, d)),
        "late_tops": lambda s, d: invariants.late_tops(_match(s, d)),
        "log_append": lambda s, d: log.appended(derive.events(s, d).filter("event_type <> 'error'").select(F.col("user_id").alias("node_id"), "event_id"), "event_id"),
        "log_gaps": lambda s, d: log.gaps(derive.log(s, d)),
        "log_entry_at": lambda s, d: log.entry_at(derive.log(s, d), 401),
        "log_range_guarded": lambda s, d: log.entries(log.truncated_through(derive.log(s, d).filter("node_id > 2 or seq < 300"), 250), 290, 64),
        "log_can_serve": lambda s, d: log.can_serve(log.truncated_through(derive.log(s, d), 250), 251),
        "log_truncate_tail": lambda s, d: log.truncated_from(derive.log(s, d), 500),
        "log_truncate_prefix": lambda s, d: log.truncated_through(derive.log(s, d), 500),
        "log_matching": lambda s, d: replication.log_matching(derive.log(s, d), LEADER),
        "conflict_resolution": lambda s, d: replication.resolved(derive.log(s, d), LEADER, derive.commits(s, d)),
        "stale_terms": lambda s, d: replication.stale_terms(derive.acks(s, d), "msg_no").select("msg_no", "follower_id", "term", "seen"),
        "latest_acks": lambda s, d: replication.latest_acks(derive.acks(s, d)),
        "majority_commit": lambda s, d: replication.majority_commit(derive.log(s, d), derive.acks(s, d), LEADER, NODES),
        "follower_commits": lambda s, d: replication.follower_commits(derive.appends(s, d)),
        "divergence_check": lambda s, d: replication.divergences(derive.acks(s, d)),
        "compacted_log": lambda s, d: replication.compacted(derive.log(s, d), derive.node_states(s, d)).groupBy("node_id").agg(F.count("*").alias("entries"), F.min("seq").alias("first_seq")),
        "follower_lag": lambda s, d: replication.lags(derive.log(s, d), derive.acks(s, d), LEADER),
        "observed_terms": lambda s, d: election.observed_terms(derive.votes(s, d)).select("arrival", "voter_id", "current_term"),
        "vote_answers": lambda s, d: _answers(s, d),
        "vote_tally": lambda s, d: election.tally(_answers(s, d), NODES),
        "first_vote_per_term": lambda s, d: election.first_votes(_answers(s, d)),
        "split_brain": lambda s, d: election.split_brain(_leaders(s, d)),
        "leaders_highest_term": lambda s, d: election.highest(_leaders(s, d)),
    }


_REASON = "case when kind = 'C' then null when instrument <> book then 'WRONG_INSTRUMENT' when quantity = 0 then 'ZERO_QUANTITY' when type = 'LIMIT' and price <= 0 then 'NON_POSITIVE_PRICE' when type = 'MARKET' and tif <> 'IOC' then 'MARKET_ORDER_MUST_BE_IOC' else 'NONE' end"
_C = f"with commands as ({derive.COMMANDS_SQL}), valid as (select * from commands where {_REASON} = 'NONE'), resting as (select book, side, price, id, quantity, seq as arrival from valid where type = 'LIMIT' and tif = 'GTC'), levels as (select book, side, price, cast(sum(quantity) as bigint) as quantity, count(*) as orders from resting group by all)"
# The generator's multiplier, increment and modulus.
_A_, _C_, _M_ = 6364136223846793005, 1442695040888963407, 18446744073709551616
_KEY = "case when side = 'BUY' then -price else price end"
_L = f"with log as ({derive.LOG_SQL})"
_A = f"with acks as ({derive.ACKS_SQL}), log as ({derive.LOG_SQL}), latest as (select follower_id, coalesce(max_by(match_seq, msg_no) filter (where ok), 0) as match_seq, max_by(last_applied, msg_no) as last_applied, max_by(state_checksum, msg_no) as state_checksum, max_by(term, msg_no) as term from acks group by follower_id)"
_V = f"""with votes as ({derive.VOTES_SQL}), seen as (select *, max(term) over (partition by voter_id order by arrival) as current_term from votes),
fits as (select *, term = current_term and candidate_seq >= voter_seq as fit from seen),
voted as (select f.*, (select g.candidate_id from fits as g where g.voter_id = f.voter_id and g.term = f.term and g.arrival < f.arrival and g.fit order by g.arrival limit 1) as voted from fits as f),
answers as (select arrival, term, voter_id, candidate_id, case when term < current_term then 'STALE_TERM' when voted <> candidate_id then 'ALREADY_VOTED' when candidate_seq < voter_seq then 'STALE_LOG' else 'GRANTED' end as answer from voted),
tally as (select term, candidate_id, count(distinct voter_id) as votes, count(distinct voter_id) >= 3 as won from answers where answer = 'GRANTED' group by all),
leaders as (select term, candidate_id as leader from tally where votes >= 2)"""


def oracle_sql() -> dict[str, str]:
    names = "case event_id % 9 when 0 then 'NONE' when 1 then 'DUPLICATE_ORDER_ID' when 2 then 'UNKNOWN_ORDER_ID' when 3 then 'ZERO_QUANTITY' when 4 then 'NON_POSITIVE_PRICE' when 5 then 'WRONG_INSTRUMENT' when 6 then 'MARKET_ORDER_MUST_BE_IOC' else '?' end"
    return fold_sql.SQL | fold_sql.VIOLATIONS | {
        "derived_commands": derive.COMMANDS_SQL,
        "parse_orders": f"{_C} select book, seq, kind, id, side, type, tif, price, quantity from commands",
        "wal_roundtrip": f"{_C} select book, seq, cast(floor((seq - 1) / 100) as bigint) + 1 as term, kind, id, instrument, side, type, tif, price, quantity from commands",
        # a record has a header of 16 bytes, an entry of 16 and a tag; a cancel has 8 more, a new order 31
        "wal_torn_tail": f"{_C} select book, count(*) - 1 as records, cast(max_by(case when kind = 'C' then 41 else 64 end, seq) - 7 as bigint) as torn_bytes from commands group by book",
        "validate_stateless": f"{_C} select book, seq, {_REASON} as reason from commands",
        "command_mix": f"{_C} select kind, type, tif, count(*) as commands, cast(coalesce(sum(quantity), 0) as bigint) as quantity from commands group by all",
        "enum_names": f"select event_id, case event_id % 3 when 0 then 'BUY' when 1 then 'SELL' else '?' end as side, case event_id % 3 when 0 then 'SELL' when 1 then 'BUY' end as opposite, {names} as reason, case when event_id % 9 < 7 then event_id % 9 end as reason_code, case event_id % 4 when 0 then 'GTC' when 1 then 'IOC' end as tif from events",
        "static_book_depth": f"{_C} select * from levels",
        "static_top_of_book": f"{_C} select book, max(price) filter (where side = 'BUY') as bid_price, max_by(quantity, price) filter (where side = 'BUY') as bid_qty, min(price) filter (where side = 'SELL') as ask_price, min_by(quantity, price) filter (where side = 'SELL') as ask_qty from levels group by book",
        "static_quantity_at": f"{_C} select book, cast(coalesce(sum(quantity) filter (where side = 'BUY' and price = 107), 0) as bigint) as quantity from resting group by book",
        "static_order_counts": f"{_C} select book, count(*) as orders, false as is_empty from resting group by book",
        "static_front_level": f"{_C} select book, side, price, id, quantity from resting qualify dense_rank() over (partition by book, side order by {_KEY}) = 1",
        "static_contains": f"{_C} select book, seq, id from commands where kind = 'C' and (book, id) in (select book, id from resting)",
        "book_order_walk": f"{_C} select book, side, row_number() over (partition by book, side order by {_KEY}, arrival) as place, price, arrival, id, quantity from resting",
        "crossing_pairs": f"{_C} select b.book, b.price as bid_price, b.quantity as bid_qty, a.price as ask_price, a.quantity as ask_qty from levels as b join levels as a on a.book = b.book and b.side = 'BUY' and a.side = 'SELL' and a.price <= b.price",
        "sweep_single_aggressor": f"""{_C}, queued as (select *, coalesce(sum(quantity) over (partition by book, side order by {_KEY}, arrival rows between unbounded preceding and 1 preceding), 0) as before_qty from resting),
            agg as (select * from valid where tif = 'IOC')
            select q.book, a.id as aggressor_id, q.id as resting_id, q.price, cast(least(q.quantity, a.quantity - q.before_qty) as bigint) as quantity
            from agg as a join queued as q on q.book = a.book and q.side <> a.side and q.before_qty < a.quantity
            where a.type = 'MARKET' or (a.side = 'BUY' and q.price <= a.price) or (a.side = 'SELL' and q.price >= a.price)""",
        "percentile_floor": f"{_C}, ranked as (select book, quantity, row_number() over (partition by book order by quantity) as r, count(*) over (partition by book) as n from commands where kind = 'N') select book, quantity as percentile from ranked where r - 1 = cast(floor(0.99 * (n - 1)) as bigint)",
        "amplification_ratios": f"with messages as ({derive.MESSAGES_SQL}), s as (select count(*) as messages, cast(sum(entries) as bigint) as entries, cast(sum(n_bytes) as bigint) as n_bytes from messages), c as (select count(*) as commands from events) select *, messages * 1000 // commands as messages_per_1000, entries * 1000 // commands as entries_per_1000, n_bytes * 1000 // commands as n_bytes_per_1000 from s, c",
        "log_accepted": f"""{_L}, one as (select node_id, seq from log where not (node_id = 3 and seq % 1000 = 0)), offered as (select node_id, seq, seq * 2 as arrival from one union all select node_id, seq, seq * 2 + 1 from one where seq % 100 = 0),
            cuts as (select node_id, min(seq) as cut from (select node_id, seq, seq - coalesce(lag(seq) over (partition by node_id order by seq), 0) as step from one) as x where step > 1 group by node_id)
            select node_id, seq, arrival, arrival % 2 = 0 and (cut is null or seq < cut) as accepted from offered left join cuts using (node_id)""",
        "log_append": "select user_id as node_id, event_id, row_number() over (partition by user_id order by event_id) as seq from events where event_type <> 'error'",
        "log_term_at": f"{_L}, n as (select node_id, unnest(range(0, max(seq) + 2)) as seq from log group by node_id) select node_id, n.seq, case when n.seq = 0 then 0 when n.seq = 100 then 1 else l.term end as term from n left join (select node_id, seq, term from log where seq > 100) as l using (node_id, seq)",
        "log_cleared": f"{_L} select distinct node_id, cast(101 as bigint) as first_seq, cast(100 as bigint) as last_seq, cast(0 as bigint) as size from log",
        "recovery_report": f"""{_C}, ends as (select book, max(seq) // 4 as q, max(seq) as n from commands group by book), had as (select book, case when book % 2 = 0 and q > 0 then q else 0 end as at_, book % 2 = 0 and q > 0 as had from ends),
            left_ as (select c.book, c.seq, h.at_ from commands as c join had as h using (book) where c.seq % 150 <> 0), gap as (select book, min(seq) as g from commands join had using (book) where seq % 150 = 0 and seq > at_ group by book),
            done as (select l.book, count(*) as replayed, max(seq) as to_ from left_ as l left join gap using (book) where seq > at_ and (g is null or seq < g) group by l.book), head as (select book, max(seq) as head from commands where seq % 150 <> 0 group by book)
            select h.book, h.had as had_snapshot, h.at_ as snapshot_seq, coalesce(d.replayed, 0) as replayed, coalesce(d.to_, h.at_) as last_seq, head > coalesce(d.to_, h.at_) as stopped_at_gap from had as h left join done as d using (book) join head using (book)""",
        "malformed_orders": f"""{_C} select cast(book as varchar) as file, seq as line_no, ['expected: N <id> <side> <type> <tif> <price> <qty>', 'bad side: UP', 'bad type: STOP', 'bad time in force: DAY', 'expected: C <id>', 'unknown command: MODIFY'][(seq // 11) % 6 + 1] as error
            from commands where seq % 11 = 0""",
        "cluster_nodes": f"""with n as ({derive.NODE_LINES_SQL}) select file, line_no, case k when 1 then e when 2 then null when 3 then e when 4 then e else node_id end as node_id,
            case k when 1 then 'a' when 2 then 'host' when 3 then 'host' when 4 then null else host end as host, case k when 1 then 1 when 2 then e % 9 + 1 when 3 then 65536 + e when 4 then null else port end as port,
            case k when 1 then 'unknown directive: peer' when 2 then 'expected: node <id> <host> <port>' when 3 then 'port out of range: ' || (65536 + e) when 4 then 'expected: node <id> <host> <port>' else case when again then 'duplicate node id: ' || node_id end end as error from n""",
        "cluster_others": f"with n as (select * from ({derive.NODE_LINES_SQL}) as x where fits and not again) select file, node_id, host, port, file in (select file from n where node_id = 3) as has_3 from n where node_id <> 3",
        "vote_files": "select event_id, case when bad then 0 else event_id * 3 end as term, case when bad then 0 else user_id % 6 end as voted_for, bad as damaged from (select *, event_id % 11 = 0 or event_id % 7 = 0 as bad from events) as e",
        # records as in wal_torn_tail
        "wal_truncated": f"""{_C}, ends as (select book, max(seq) // 2 as through from commands group by book), kept as (select c.*, seq > through and book % 2 = 0 as stays from commands as c join ends using (book))
            select book, cast(count(*) filter (where stays) as bigint) as records, cast(coalesce(sum(case when kind = 'C' then 41 else 64 end) filter (where stays), 0) as bigint) as good_bytes, cast(0 as bigint) as torn_bytes from kept group by book""",
        "wal_headers": f"{_C} select book, cast(1279350623 as bigint) as magic, cast(1 as bigint) as seq, cast(min_by(case when kind = 'C' then 25 else 48 end, seq) as bigint) as size from commands group by book",
        # sizes: a header of 12 bytes and the body of each kind; the last message of a stream lacks 5 bytes
        "captured_messages": f"""with w as ({derive.WIRE_SQL}), m as (select book, msg_no, n, size, code, 12 + case code when 1 then 10 + n when 2 then 12 when 3 then 12 + size when 4 then 20 when 10 then 40 + n * (16 + size) when 11 then 37 when 20 then 20 else 13 end as n_bytes from w),
            named as (select book, msg_no, n_bytes, map {{1: 'HELLO', 2: 'HEARTBEAT', 3: 'COMMAND_FORWARD', 4: 'EVENT_ACK', 10: 'APPEND_ENTRIES', 11: 'APPEND_RESPONSE', 20: 'REQUEST_VOTE', 21: 'VOTE_RESPONSE'}}[code] as kind, case when code = 10 then n else 0 end as entries, max(msg_no) over (partition by book) = msg_no as last_ from m)
            select book, msg_no, n_bytes - case when last_ then 5 else 0 end as n_bytes, case when not last_ then kind end as kind, case when last_ then 0 else entries end as entries, case when last_ then 'CUT_OFF' end as error from named""",
        # the rules of a member, one message of each node at a step; a draw of the generator sets each timeout
        "member_actions": f"""with recursive box as materialized (select *, row_number() over (partition by node_id order by ordinal) as r from ({derive.INBOX_SQL}) as x),
            nodes as (select n as node_id, (cast(1000 + n as uhugeint) * {_A_}::uhugeint + {_C_}::uhugeint) % {_M_}::uhugeint as s from (select unnest(range(1, 6)) as n) as x),
            walk as (
              select node_id, cast(0 as bigint) as r, 'FOLLOWER' as role, cast(0 as bigint) as term, cast(null as bigint) as vote, cast([] as bigint[]) as votes, cast(0 as bigint) as log_seq, cast(0 as bigint) as sent, cast(0 as bigint) as heard,
                150 + cast((s >> 17) % 151 as bigint) as timeout, s, cast([] as struct(action varchar, to_ bigint, term bigint, log_seq bigint, granted boolean)[]) as acts, cast(null as bigint) as ordinal, cast(null as bigint) as at_ from nodes
              union all
              select node_id, r, case when kind = 'RESET' then 'FOLLOWER' when steps or concedes then 'FOLLOWER' when campaigns then 'CANDIDATE' when wins then 'LEADER' else role end,
                case when kind = 'RESET' then 0 when adopts then mterm when campaigns then term + 1 else term end,
                case when kind = 'RESET' then null when campaigns then node_id when grants then peer when adopts then null else vote end,
                case when kind = 'RESET' or adopts then [] when campaigns then [node_id] when counts then list_append(votes, peer) else votes end,
                case when kind = 'LOG' then mlog else log_seq end, case when kind = 'RESET' then 0 when beats or wins then at_ else sent end, case when kind = 'RESET' then 0 when waits then at_ else heard end,
                case when twice then 150 + cast((s2 >> 17) % 151 as bigint) when waits then 150 + cast((s1 >> 17) % 151 as bigint) else timeout end, case when twice then s2 when waits then s1 else s end,
                case when beats then [struct_pack(action := 'HEARTBEAT', to_ := p, term := term, log_seq := cast(null as bigint), granted := cast(null as boolean)) for p in peers]
                  when campaigns then [struct_pack(action := 'REQUEST_VOTE', to_ := p, term := term + 1, log_seq := log_seq, granted := cast(null as boolean)) for p in peers]
                  when kind = 'REQUEST_VOTE' then [struct_pack(action := 'VOTE', to_ := peer, term := greatest(term, mterm), log_seq := cast(null as bigint), granted := grants)]
                  when wins then list_concat([struct_pack(action := 'BECAME_LEADER', to_ := node_id, term := term, log_seq := cast(null as bigint), granted := cast(null as boolean))], [struct_pack(action := 'HEARTBEAT', to_ := p, term := term, log_seq := cast(null as bigint), granted := cast(null as boolean)) for p in peers])
                  when tells then [struct_pack(action := 'STEPPED_DOWN', to_ := node_id, term := mterm, log_seq := cast(null as bigint), granted := cast(null as boolean))] else [] end, ordinal, at_
              from (
                select *, adopts as steps, kind = 'APPEND' and mterm >= term as concedes, kind = 'REQUEST_VOTE' and mterm >= term and (adopts or vote is null or vote = peer) and mlog >= log_seq as grants,
                  kind = 'VOTE' and not adopts and role = 'CANDIDATE' and mterm = term and said and not list_contains(votes, peer) as counts,
                  kind = 'VOTE' and not adopts and role = 'CANDIDATE' and mterm = term and said and not list_contains(votes, peer) and len(votes) + 1 >= 3 as wins,
                  (kind = 'APPEND' and mterm >= term and role = 'LEADER' and not adopts) or (kind = 'APPEND_RESPONSE' and adopts) as tells,
                  campaigns or adopts or (kind = 'APPEND' and mterm >= term) or (kind = 'REQUEST_VOTE' and mterm >= term and (adopts or vote is null or vote = peer) and mlog >= log_seq) as waits,
                  adopts and ((kind = 'APPEND') or (kind = 'REQUEST_VOTE' and mlog >= log_seq)) as twice,
                  (s1 * {_A_}::uhugeint + {_C_}::uhugeint) % {_M_}::uhugeint as s2
                from (
                  select w.* exclude (r, acts, ordinal, at_), b.r, b.ordinal, b.at as at_, b.kind, b.term as mterm, b.peer, b.granted as said, b.log_seq as mlog, list_filter([1, 2, 3, 4, 5], lambda p: p <> w.node_id) as peers,
                    b.kind in ('REQUEST_VOTE', 'VOTE', 'APPEND', 'APPEND_RESPONSE') and b.term > w.term as adopts, b.kind = 'TICK' and w.role = 'LEADER' and b.at - w.sent >= 50 as beats, b.kind = 'TICK' and w.role <> 'LEADER' and b.at - w.heard >= w.timeout as campaigns,
                    (w.s * {_A_}::uhugeint + {_C_}::uhugeint) % {_M_}::uhugeint as s1
                  from walk as w join box as b on b.node_id = w.node_id and b.r = w.r + 1) as x1) as x2)
            select node_id, ordinal, at_ as at, a.action, a.to_ as to, a.term, a.log_seq, a.granted, role from (select node_id, ordinal, at_, role, unnest(acts) as a from walk where len(acts) > 0) as x""",
        "reduced_orders": f"{_C}, taken as (select book, id, count(*) as by_ from commands where kind = 'C' group by all) select r.book, r.side, r.price, r.id, cast(r.quantity - coalesce(by_, 0) as bigint) as quantity from resting as r left join taken as t on t.book = r.book and t.id = r.id where r.quantity > coalesce(by_, 0)",
        "generated_flow": """with recursive seeds(book, seed) as (values (1, 7), (2, 12648430)), draw as (
            select cast(book as bigint) as book, cast(0 as bigint) as seq, cast(seed as uhugeint) as s, cast([] as bigint[]) as live, cast(0 as bigint) as ids, 'N' as kind, cast(0 as bigint) as id, cast(null as varchar) as side, cast(null as varchar) as type, cast(null as varchar) as tif, cast(null as bigint) as price, cast(null as bigint) as quantity from seeds
            union all
            select book, seq + 1, case when cancels then s2 when market then s3 else s4 end, case when cancels then list_concat(live[:k], live[k + 2:]) when rests then list_append(live, ids + 1) else live end, case when cancels then ids else ids + 1 end,
              case when cancels then 'C' else 'N' end, case when cancels then live[k + 1] else ids + 1 end, case when not cancels then case when (s2 >> 17) % 2 = 0 then 'BUY' else 'SELL' end end, case when not cancels then case when market then 'MARKET' else 'LIMIT' end end,
              case when not cancels then case when rests then 'GTC' else 'IOC' end end, case when not cancels then case when market then 0 else cast(9950 + (s4 >> 17) % 101 as bigint) end end, case when not cancels then cast(1 + (s3 >> 17) % 50 as bigint) end
            from (select *, roll < 15 and len(live) > 0 as cancels, roll >= 92 as market, roll < 85 and not (roll < 15 and len(live) > 0) as rests, case when len(live) > 0 then cast((s2 >> 17) % len(live) as bigint) end as k
              from (select *, cast((s1 >> 17) % 100 as bigint) as roll, (s3 * 6364136223846793005::uhugeint + 1442695040888963407::uhugeint) % 18446744073709551616::uhugeint as s4
                from (select *, (s2 * 6364136223846793005::uhugeint + 1442695040888963407::uhugeint) % 18446744073709551616::uhugeint as s3
                  from (select *, (s1 * 6364136223846793005::uhugeint + 1442695040888963407::uhugeint) % 18446744073709551616::uhugeint as s2
                    from (select *, (s * 6364136223846793005::uhugeint + 1442695040888963407::uhugeint) % 18446744073709551616::uhugeint as s1 from draw where seq < 1000) as a) as b) as c) as d) as e)
            select book, seq, kind, id, case when kind = 'N' then book end as instrument, side, type, tif, price, quantity from draw where seq > 0""",
        "log_bounds": f"{_L} select node_id, min(seq) as first_seq, max(seq) as last_seq, count(*) as size from log where seq > 100 group by node_id",
        "log_gaps": f"{_L} select node_id, prev as after_seq, seq as next_seq, seq - prev - 1 as missing from (select *, coalesce(lag(seq) over (partition by node_id order by seq), 0) as prev from log) as x where seq - prev > 1",
        "log_entry_at": f"{_L} select * from log where seq = 401",
        "log_range_guarded": f"{_L}, kept as (select * from log where (node_id > 2 or seq < 300) and seq > 250) select * from kept where seq between 290 and 353 and node_id in (select node_id from kept group by node_id having min(seq) <= 290 and max(seq) >= 290)",
        "log_can_serve": f"{_L}, kept as (select * from log where seq > 250) select node_id, 251 = max(seq) + 1 or (251 between min(seq) and max(seq)) as can_serve from kept group by node_id",
        "log_truncate_tail": f"{_L} select * from log where seq < 500",
        "log_truncate_prefix": f"{_L} select * from log where seq > 500",
        "log_matching": f"""{_L}, lead_ as (select seq, coalesce(lag(term) over (order by seq), 0) as prev_term from log where node_id = 1)
            select n.node_id, case when l.seq = 1 then 'MATCH' when h.term is null then 'GAP' when h.term <> l.prev_term then 'CONFLICT' else 'MATCH' end as verdict, count(*) as entries, min(l.seq) as first_seq
            from lead_ as l cross join (select distinct node_id from log where node_id <> 1) as n left join log as h on h.node_id = n.node_id and h.seq = l.seq - 1 group by 1, 2""",
        "conflict_resolution": f"""{_L}, commits as ({derive.COMMITS_SQL}), cuts as (select o.node_id, min(o.seq) as cut from log as o join log as l on l.node_id = 1 and l.seq = o.seq where o.node_id <> 1 and o.term <> l.term group by o.node_id),
            known as (select c.node_id, cut, cut <= commit_seq as refused from cuts as c join commits using (node_id))
            select node_id, max(seq) as kept_through, count(*) as kept, max(cut) as first_divergence, coalesce(bool_or(refused), false) as refused from log left join known using (node_id)
            where node_id <> 1 and (cut is null or refused or seq < cut) group by node_id""",
        "stale_terms": f"{_A} select msg_no, follower_id, term, seen from (select *, max(term) over (partition by follower_id order by msg_no rows between unbounded preceding and 1 preceding) as seen from acks) as x where term < seen",
        "latest_acks": f"{_A} select * from latest",
        "majority_commit": f"""{_A}, head as (select max(seq) as match_seq, max(term) as own_term from log where node_id = 1), points as (select match_seq from latest union all select match_seq from head),
            ranked as (select coalesce((select match_seq from (select match_seq, row_number() over (order by match_seq desc) as r from points) as x where r = 3), 0) as candidate)
            select candidate, term as candidate_term, own_term, case when candidate > 0 and term = own_term then candidate else 0 end as commit_seq from ranked cross join head left join (select seq, term from log where node_id = 1) as l on l.seq = candidate""",
        # message by message: the index moves if the leader's is beyond it, to the least of that and the own end
        "follower_commits": f"""with recursive a as materialized (select *, row_number() over (partition by follower_id order by msg_no) as r from ({derive.APPENDS_SQL}) as x),
            walk as (select follower_id, msg_no, r, case when leader_commit > 0 then least(leader_commit, last_seq) else 0 end as commit_seq from a where r = 1
              union all select a.follower_id, a.msg_no, a.r, case when a.leader_commit > w.commit_seq then greatest(w.commit_seq, least(a.leader_commit, a.last_seq)) else w.commit_seq end from walk as w join a on a.follower_id = w.follower_id and a.r = w.r + 1)
            select follower_id, msg_no, commit_seq from walk""",
        "divergence_check": f"{_A} select last_applied, count(distinct state_checksum) as checksums, count(*) as reports from acks group by last_applied having count(distinct state_checksum) > 1",
        "compacted_log": f"""{_L}, states as ({derive.NODE_STATES_SQL}) select node_id, count(*) as entries, min(seq) as first_seq from log join states using (node_id)
            where seq > case when role = 'LEADER' and backups > 0 then least(commit_seq, last_applied) else 0 end group by node_id""",
        "follower_lag": f"{_A} select follower_id, head - last_applied as apply_lag, head - match_seq as log_lag from latest, (select max(seq) as head from log where node_id = 1) as h",
        "submit_status": "select event_id, case when event_id % 10 = 0 then 'NOT_PRIMARY' when event_id % 2 = 0 and event_id % 7 = 0 then 'NO_BACKUP' when event_id % 2 = 0 and cast(floor(value) as bigint) % 12 >= 8 then 'BUSY' when event_id % 11 = 0 then 'BUSY' else 'ACCEPTED' end as status from events",
        "observed_terms": f"{_V} select arrival, voter_id, current_term from seen",
        "vote_answers": f"{_V} select * from answers",
        "vote_tally": f"{_V} select * from tally",
        "first_vote_per_term": f"{_V} select voter_id, term, candidate_id, arrival from answers where answer = 'GRANTED' qualify row_number() over (partition by voter_id, term order by arrival) = 1",
        "split_brain": f"{_V} select term, count(distinct leader) as leaders from leaders group by term having count(distinct leader) > 1",
        "leaders_highest_term": f"{_V} select distinct term, leader from leaders where term = (select max(term) from leaders)",
    }
