"""Validators of a replicated log over tables of logs, acknowledgements and messages.

The live protocol is Spark's own business (checkpoints, offsets, the driver); these operators check what such a protocol
must satisfy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def majority(nodes: int) -> int:
    return nodes // 2 + 1


def submit_status(rows: DataFrame, window: int) -> DataFrame:
    """What a leader answers to each submit (is_primary, synchronous, backups, last_seq, commit_seq, saturated), in this
    order of rules."""
    c = F.col
    status = F.when(~c("is_primary"), "NOT_PRIMARY").when(c("synchronous") & (c("backups") == 0), "NO_BACKUP").when(c("synchronous") & (c("last_seq") - c("commit_seq") >= window), "BUSY").when(c("saturated"), "BUSY").otherwise("ACCEPTED")
    return rows.withColumn("status", status)


def stale_terms(messages: DataFrame, order: str) -> DataFrame:
    """Messages of a term below the highest seen before them, by node: they are refused."""
    w = W.partitionBy("follower_id").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return messages.withColumn("seen", F.max("term").over(w)).filter("term < seen")


def log_matching(log: DataFrame, leader: int) -> DataFrame:
    """How many entries of the leader match the log of every other node before them: MATCH, GAP (the node lacks the entry
    before) or CONFLICT (it has another term there). The entry before joins by sequence."""
    mine = log.filter(F.col("node_id") == leader)
    before = mine.select((F.col("seq") + 1).alias("seq"), F.col("term").alias("prev_term"))
    asked = mine.select("seq").join(before, "seq", "left").select("seq", F.coalesce("prev_term", F.lit(0).cast("long")).alias("prev_term"))
    others = log.filter(F.col("node_id") != leader)
    # one row a node: as many as the cluster has
    pairs = asked.crossJoin(F.broadcast(others.select("node_id").distinct()))
    held = others.select("node_id", (F.col("seq") + 1).alias("seq"), F.col("term").alias("held_term"))
    verdict = F.when(F.col("seq") == 1, "MATCH").when(F.col("held_term").isNull(), "GAP").when(F.col("held_term") != F.col("prev_term"), "CONFLICT").otherwise("MATCH")
    return pairs.join(held, ["node_id", "seq"], "left").select("node_id", "seq", verdict.alias("verdict")).groupBy("node_id", "verdict").agg(F.count("*").alias("entries"), F.min("seq").alias("first_seq"))


def resolved(log: DataFrame, leader: int, commits: DataFrame | None = None) -> DataFrame:
    """What a follower keeps of its log when the leader's comes: entries below its first divergence from the leader. A
    divergence at or below the follower's commit index (commits: node_id, commit_seq) is refused and cuts nothing."""
    mine = log.filter(F.col("node_id") == leader).select("seq", F.col("term").alias("leader_term"))
    others = log.filter(F.col("node_id") != leader)
    first = others.join(mine, "seq").filter("term <> leader_term").groupBy("node_id").agg(F.min("seq").alias("cut"))
    known = commits if commits is not None else others.select("node_id", F.lit(0).cast("long").alias("commit_seq")).distinct()
    first = first.join(known.select("node_id", "commit_seq"), "node_id", "left").withColumn("refused", F.col("cut") <= F.coalesce("commit_seq", F.lit(0)))
    kept = others.join(first, "node_id", "left").filter("cut is null or refused or seq < cut")
    return kept.groupBy("node_id").agg(F.max("seq").alias("kept_through"), F.count("*").alias("kept"), F.max("cut").alias("first_divergence"), F.coalesce(F.max("refused"), F.lit(False)).alias("refused"))


def latest_acks(acks: DataFrame) -> DataFrame:
    """Of each follower the match point of its last positive answer and what it last said of its state; an answer that
    is not ok moves no match point."""
    ok = F.when(F.col("ok"), F.struct("msg_no", "match_seq"))
    last = F.max_by(F.struct("last_applied", "state_checksum", "term"), "msg_no")
    return acks.groupBy("follower_id").agg(F.max(ok).alias("m"), last.alias("l")).select("follower_id", F.coalesce("m.match_seq", F.lit(0).cast("long")).alias("match_seq"), "l.last_applied", "l.state_checksum", "l.term")


def majority_commit(log: DataFrame, acks: DataFrame, leader: int, nodes: int, commit: int = 0) -> DataFrame:
    """The commit index a leader may set: the highest sequence that a majority of the configured nodes holds, if that is
    beyond `commit` and the entry there is of the leader's own term. An older term's entry never commits by count."""
    mine = log.filter(F.col("node_id") == leader)
    head = mine.agg(F.max("seq").alias("match_seq"), F.max("term").alias("own_term"))
    points = latest_acks(acks).select("match_seq").unionAll(head.select("match_seq"))
    need = majority(nodes)
    # one row a node: the list is as long as the cluster is wide
    listed = points.agg(F.sort_array(F.collect_list(F.coalesce("match_seq", F.lit(0).cast("long"))), asc=False).alias("m")).select(F.coalesce(F.get("m", F.lit(need - 1)), F.lit(0).cast("long")).alias("candidate"))
    found = listed.join(mine.select(F.col("seq").alias("candidate"), "term"), "candidate", "left").crossJoin(F.broadcast(head.select("own_term")))
    may = (F.col("candidate") > commit) & (F.col("term") == F.col("own_term"))
    return found.select("candidate", F.col("term").alias("candidate_term"), "own_term", F.when(may, F.col("candidate")).otherwise(F.lit(commit).cast("long")).alias("commit_seq"))


def follower_commits(appends: DataFrame) -> DataFrame:
    """How the commit index of each follower moves with a leader's messages (follower_id, msg_no, leader_commit, last_seq):
    one that is beyond the follower's index sets it to the least of the leader's and the follower's own last sequence.

    The index is the running maximum of these: the own last sequence never falls below what is committed."""
    w = W.partitionBy("follower_id").orderBy("msg_no").rowsBetween(W.unboundedPreceding, 0)
    return appends.select("follower_id", "msg_no", F.max(F.least("leader_commit", "last_seq")).over(w).alias("commit_seq"))


def divergences(acks: DataFrame) -> DataFrame:
    """Points that nodes have applied with more than one checksum."""
    return acks.groupBy("last_applied").agg(F.count_distinct("state_checksum").alias("checksums"), F.count("*").alias("reports")).filter("checksums > 1")


def compacted(log: DataFrame, states: DataFrame) -> DataFrame:
    """The logs after each node (states: node_id, role, backups, commit_seq, last_applied) has dropped what is both
    committed and applied; only a leader that has followers drops anything."""
    safe = F.when((F.col("role") == "LEADER") & (F.col("backups") > 0), F.least("commit_seq", "last_applied")).otherwise(F.lit(0).cast("long"))
    upto = states.select("node_id", safe.alias("safe"))
    return log.join(upto, "node_id", "left").filter("safe is null or seq > safe").drop("safe")


def lags(log: DataFrame, acks: DataFrame, leader: int) -> DataFrame:
    """How far each follower is behind the leader's head, in applied and in held entries."""
    head = log.filter(F.col("node_id") == leader).agg(F.max("seq").alias("head"))
    return latest_acks(acks).crossJoin(F.broadcast(head)).select("follower_id", (F.col("head") - F.col("last_applied")).alias("apply_lag"), (F.col("head") - F.col("match_seq")).alias("log_lag"))


def amplification(messages: DataFrame, commands: DataFrame) -> DataFrame:
    """Messages, entries and bytes for each command."""
    n = commands.agg(F.count("*").alias("commands"))
    sums = messages.agg(F.count("*").alias("messages"), F.sum("entries").alias("entries"), F.sum("n_bytes").alias("n_bytes"))
    per = lambda c: F.floor(F.col(c) * 1000 / F.col("commands")).cast("long").alias(f"{c}_per_1000")
    return sums.crossJoin(F.broadcast(n)).select("commands", "messages", "entries", "n_bytes", per("messages"), per("entries"), per("n_bytes"))
