"""Order flow and cluster tables derived from the `events` table by integer rules, and the same rules as SQL.

There are no orders among the driver's tables, so a fixed flow is derived: eight books, all order types, every reject
reason that needs no book, and cancels of recent ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BOOKS = 8


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived command log of all books."""
    e = F.col("event_id")
    in_book = W.partitionBy("book").orderBy("event_id")
    rows = events(spark, sf_dir).select("event_id", "event_type", "value", (F.col("user_id") % BOOKS).alias("book"))
    rows = rows.withColumn("seq", F.row_number().over(in_book).cast("long")).withColumn("before", F.coalesce(F.lag("event_id", 3).over(in_book), F.lit(-1)) + 1)
    cancel = F.col("event_type") == "error"
    bad = e % 389 == 0
    market = (F.col("event_type") == "purchase") & (e % 3 == 0)
    ioc = (F.col("event_type") == "signup") & (e % 5 == 0)
    new = lambda v: F.when(~cancel, v)
    return rows.select(
        "book", "seq", F.when(cancel, "C").otherwise("N").alias("kind"), F.when(cancel, F.col("before")).otherwise(e + 1).alias("id"),
        new(F.when(e % 97 == 0, F.col("book") + 1).otherwise(F.col("book"))).alias("instrument"),
        new(F.when(e % 2 == 0, "BUY").otherwise("SELL")).alias("side"),
        new(F.when(bad | market, "MARKET").otherwise("LIMIT")).alias("type"),
        new(F.when(bad, "GTC").when(market | ioc, "IOC").otherwise("GTC")).alias("tif"),
        new(F.when(e % 211 == 0, F.lit(0).cast("long")).otherwise(100 + (e * 37) % 21)).alias("price"),
        new(F.when(e % 307 == 0, F.lit(0).cast("long")).otherwise(1 + F.floor("value").cast("long") % 50)).alias("quantity"),
    )


COMMANDS_SQL = """
select book, seq, case when cancel then 'C' else 'N' end as kind, case when cancel then before_id else event_id + 1 end as id,
  case when not cancel then case when event_id % 97 = 0 then book + 1 else book end end as instrument,
  case when not cancel then case when event_id % 2 = 0 then 'BUY' else 'SELL' end end as side,
  case when not cancel then case when event_id % 389 = 0 or market then 'MARKET' else 'LIMIT' end end as type,
  case when not cancel then case when event_id % 389 = 0 then 'GTC' when market or ioc then 'IOC' else 'GTC' end end as tif,
  case when not cancel then case when event_id % 211 = 0 then 0 else 100 + (event_id * 37) % 21 end end as price,
  case when not cancel then case when event_id % 307 = 0 then 0 else 1 + cast(floor(value) as bigint) % 50 end end as quantity
from (select event_id, user_id % 8 as book, value, event_type = 'error' as cancel, event_type = 'purchase' and event_id % 3 = 0 as market,
    event_type = 'signup' and event_id % 5 = 0 as ioc,
    cast(row_number() over (partition by user_id % 8 order by event_id) as bigint) as seq,
    coalesce(lag(event_id, 3) over (partition by user_id % 8 order by event_id), -1) + 1 as before_id
  from events) as x
"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, seq, term): the logs of five nodes. Node k lacks the last 37 (k - 1) entries, node 4 holds some in a
    later term, node 5 lacks every 997th."""
    one = events(spark, sf_dir).select((F.col("event_id") + 1).alias("seq"), (1 + F.floor(F.col("event_id") / 500.0).cast("long")).alias("term"))
    n = one.agg(F.max("seq").alias("n"))
    nodes = spark.range(1, 6).select(F.col("id").alias("node_id"))
    # five nodes and one row of a maximum: both sides are fixed in size
    kept = one.join(F.broadcast(nodes.crossJoin(n)), F.expr("seq <= n - 37 * (node_id - 1) and not (node_id = 5 and seq % 997 = 0)"))
    return kept.select("node_id", "seq", F.when(F.expr("node_id = 4 and seq % 401 = 0"), F.col("term") + 1).otherwise(F.col("term")).alias("term"))


LOG_SQL = """
select node_id, seq, case when node_id = 4 and seq % 401 = 0 then term + 1 else term end as term
from (select event_id + 1 as seq, 1 + cast(floor(event_id / 500.0) as bigint) as term from events) as e,
  (select cast(x as bigint) as node_id from (values (1), (2), (3), (4), (5)) as v(x)) as nodes, (select max(event_id) + 1 as n from events) as m
where seq <= n - 37 * (node_id - 1) and not (node_id = 5 and seq % 997 = 0)
"""


def acks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(msg_no, follower_id, term, ok, match_seq, last_applied, state_checksum): answers of followers 2 to 5."""
    e, v = F.col("event_id"), F.floor("value").cast("long")
    back = F.greatest(F.lit(0).cast("long"), e - v % 40)
    return events(spark, sf_dir).select(
        e.alias("msg_no"), (F.col("user_id") % 4 + 2).alias("follower_id"), (1 + F.floor(e / 500.0).cast("long") - F.when(e % 53 == 0, 1).otherwise(0)).alias("term"),
        (F.col("event_type") != "error").alias("ok"), back.alias("match_seq"), (back - back % 5).alias("last_applied"), (((back - back % 5) * 1000003 + F.when(e % 701 == 0, 1).otherwise(0)) % 1000000007).alias("state_checksum"),
    )


ACKS_SQL = """
select event_id as msg_no, user_id % 4 + 2 as follower_id, 1 + cast(floor(event_id / 500.0) as bigint) - case when event_id % 53 = 0 then 1 else 0 end as term,
  event_type <> 'error' as ok, back as match_seq, back - back % 5 as last_applied,
  ((back - back % 5) * 1000003 + case when event_id % 701 = 0 then 1 else 0 end) % 1000000007 as state_checksum
from (select *, greatest(0, event_id - cast(floor(value) as bigint) % 40) as back from events) as e
"""


def appends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(follower_id, msg_no, leader_commit, last_seq): what followers 2 to 5 learn of the leader's commit index, and the end
    of their own logs then."""
    e, v = F.col("event_id"), F.floor("value").cast("long")
    return events(spark, sf_dir).select((F.col("user_id") % 4 + 2).alias("follower_id"), e.alias("msg_no"), F.greatest(F.lit(0).cast("long"), e - v % 60).alias("leader_commit"), (e - e % 25).alias("last_seq"))


APPENDS_SQL = "select user_id % 4 + 2 as follower_id, event_id as msg_no, greatest(0, event_id - cast(floor(value) as bigint) % 60) as leader_commit, event_id - event_id % 25 as last_seq from events"


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(arrival, term, voter_id, candidate_id, candidate_seq, voter_seq): requests for votes as voters get them."""
    e, v = F.col("event_id"), F.floor("value").cast("long")
    return events(spark, sf_dir).select(e.alias("arrival"), (1 + F.floor(e / 20.0).cast("long")).alias("term"), (F.col("user_id") % 5 + 1).alias("voter_id"), (1 + v % 3).alias("candidate_id"), (e + v % 7).alias("candidate_seq"), (e + v % 5).alias("voter_seq"))


VOTES_SQL = """
select event_id as arrival, 1 + cast(floor(event_id / 20.0) as bigint) as term, user_id % 5 + 1 as voter_id, 1 + cast(floor(value) as bigint) % 3 as candidate_id,
  event_id + cast(floor(value) as bigint) % 7 as candidate_seq, event_id + cast(floor(value) as bigint) % 5 as voter_seq
from events
"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(msg_no, kind, entries, n_bytes): traffic of a leader."""
    e, v = F.col("event_id"), F.floor("value").cast("long")
    kind = F.when(F.col("event_type").isin("click", "view"), "APPEND").when(F.col("event_type") == "error", "ADVERT").otherwise("RESPONSE")
    n = F.when(kind == "APPEND", 1 + v % 3).otherwise(0)
    return events(spark, sf_dir).select(e.alias("msg_no"), kind.alias("kind"), n.cast("long").alias("entries"), (F.when(kind == "RESPONSE", 49).otherwise(52 + 48 * n)).cast("long").alias("n_bytes"))


MESSAGES_SQL = """
select msg_no, kind, entries, case when kind = 'RESPONSE' then 49 else 52 + 48 * entries end as n_bytes
from (select event_id as msg_no, case when event_type in ('click', 'view') then 'APPEND' when event_type = 'error' then 'ADVERT' else 'RESPONSE' end as kind,
  case when event_type in ('click', 'view') then 1 + cast(floor(value) as bigint) % 3 else 0 end as entries from events) as e
"""


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, line_no, value): order lines, one file a book; every eleventh line of a file is damaged in one of six ways."""
    from ledgerloom.sources import orders

    kind = (F.col("seq") / 11).cast("long") % 6
    bad = (
        F.when(kind == 0, "N 1 BUY LIMIT GTC ten 5").when(kind == 1, "N 1 UP LIMIT GTC 10 5").when(kind == 2, "N 1 BUY STOP GTC 10 5").when(kind == 3, "NEW 1 SELL LIMIT DAY 10 5").when(kind == 4, "C").otherwise("MODIFY 1")
    )
    return commands(spark, sf_dir).select(F.col("book").cast("string").alias("file"), F.col("seq").alias("line_no"), F.when(F.col("seq") % 11 == 0, bad).otherwise(orders.order_line()).alias("value"))


def node_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, line_no, value): lines of cluster files, with every error that they can have."""
    e = F.col("event_id")
    part = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    value = (
        F.when(e % 6 == 1, part("peer ", e, " a 1")).when(e % 6 == 2, part("node x host ", e % 9 + 1)).when(e % 6 == 3, part("node ", e, " host ", 65536 + e)).when(e % 6 == 4, part("node ", e, "   # no host"))
        .otherwise(part("node ", e % 40, " host", e % 3, " ", 7000 + e % 100, "  # rest"))
    )
    return events(spark, sf_dir).select((F.col("user_id") % 3).cast("string").alias("file"), e.alias("line_no"), value.alias("value"))


NODE_LINES_SQL = """
select cast(user_id % 3 as varchar) as file, event_id as line_no, event_id % 6 as k, event_id as e, event_id % 40 as node_id, 'host' || (event_id % 3) as host, 7000 + event_id % 100 as port,
  event_id % 6 in (0, 5) as fits, event_id % 6 in (0, 5) and row_number() over (partition by user_id % 3, event_id % 40, event_id % 6 in (0, 5) order by event_id) > 1 as again from events
"""


def ballots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, term, voted_for, cut, flipped): what vote files hold, and how they are damaged."""
    e = F.col("event_id")
    return events(spark, sf_dir).select(e.cast("string").alias("path"), (e * 3).alias("term"), (F.col("user_id") % 6).alias("voted_for"), (e % 11 == 0).alias("cut"), (e % 7 == 0).alias("flipped"))


def wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, msg_no, code, ...): the messages of one stream a book, a kind after the other; those of APPEND_ENTRIES carry
    the command up to four times."""
    return commands(spark, sf_dir).select(F.col("book").cast("string").alias("path"), (F.col("seq") - 1).alias("msg_no"), F.element_at(F.array(*map(F.lit, (1, 2, 3, 4, 10, 11, 20, 21))), (F.col("seq") % 8 + 1).cast("int")).alias("code"), (F.col("seq") % 5).alias("n"), "seq", "kind", "id", F.coalesce("instrument", F.lit(0)).alias("instrument"), "side", "type", "tif", "price", "quantity")


WIRE_SQL = f"""
select book, seq - 1 as msg_no, [1, 2, 3, 4, 10, 11, 20, 21][seq % 8 + 1] as code, seq % 5 as n, case when kind = 'C' then 9 else 32 end as size from ({COMMANDS_SQL}) as c
"""


def inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, ordinal, at, kind, term, peer, granted, log_seq): what five members of a cluster get, in order."""
    e, u = F.col("event_id"), F.col("user_id")
    node = u % 5 + 1
    kind = F.element_at(F.array(*map(F.lit, ("TICK", "TICK", "REQUEST_VOTE", "TICK", "VOTE", "TICK", "APPEND", "APPEND_RESPONSE", "LOG", "TICK", "VOTE"))), (e % 11 + 1).cast("int"))
    named = F.when((e % 401) == 400, "RESET").otherwise(kind)
    message = named.isin("REQUEST_VOTE", "VOTE", "APPEND", "APPEND_RESPONSE")
    peer = (node + F.floor("value").cast("long") % 4) % 5 + 1
    return events(spark, sf_dir).select(
        node.alias("node_id"), e.alias("ordinal"), (e * 7).alias("at"), named.alias("kind"), F.when(message, F.floor(e / 60).cast("long") + e % 3).alias("term"), F.when(message, peer).alias("peer"),
        F.when(named == "VOTE", e % 4 != 0).alias("granted"), F.when(named.isin("REQUEST_VOTE", "LOG"), F.floor(e / 30).cast("long")).alias("log_seq"),
    )


INBOX_SQL = """
select node_id, event_id as ordinal, event_id * 7 as at, kind, case when kind in ('REQUEST_VOTE', 'VOTE', 'APPEND', 'APPEND_RESPONSE') then event_id // 60 + event_id % 3 end as term,
  case when kind in ('REQUEST_VOTE', 'VOTE', 'APPEND', 'APPEND_RESPONSE') then (node_id + cast(floor(value) as bigint) % 4) % 5 + 1 end as peer, case when kind = 'VOTE' then event_id % 4 <> 0 end as granted,
  case when kind in ('REQUEST_VOTE', 'LOG') then event_id // 30 end as log_seq
from (select *, user_id % 5 + 1 as node_id, case when event_id % 401 = 400 then 'RESET' else ['TICK', 'TICK', 'REQUEST_VOTE', 'TICK', 'VOTE', 'TICK', 'APPEND', 'APPEND_RESPONSE', 'LOG', 'TICK', 'VOTE'][event_id % 11 + 1] end as kind from events) as e
"""


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, commit_seq): the commit index of each follower; node 4 believes that a third of the log is committed."""
    ends = log(spark, sf_dir).groupBy("node_id").agg(F.max("seq").alias("n"))
    return ends.select("node_id", F.when(F.col("node_id") == 4, F.floor(F.col("n") / 3)).otherwise(F.lit(200)).cast("long").alias("commit_seq"))


COMMITS_SQL = f"select node_id, case when node_id = 4 then max(seq) // 3 else 200 end as commit_seq from ({LOG_SQL}) as l group by node_id"


def node_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, role, backups, commit_seq, last_applied): node 1 leads the others, node 2 leads nobody."""
    ends = log(spark, sf_dir).groupBy("node_id").agg(F.max("seq").alias("n"))
    half = F.floor(F.col("n") / 2)
    return ends.select("node_id", F.when(F.col("node_id") <= 2, "LEADER").otherwise("FOLLOWER").alias("role"), F.when(F.col("node_id") == 1, 4).otherwise(0).cast("long").alias("backups"), half.alias("commit_seq"), (half - 50).alias("last_applied"))


NODE_STATES_SQL = f"select node_id, case when node_id <= 2 then 'LEADER' else 'FOLLOWER' end as role, case when node_id = 1 then 4 else 0 end as backups, max(seq) // 2 as commit_seq, max(seq) // 2 - 50 as last_applied from ({LOG_SQL}) as l group by node_id"
