"""Elections: validators over tables of vote requests, votes and leaders, and the fold of one node's inbox.

The fold is keyed by node and takes its inbox in order; what it wants sent comes out as rows. Time is a column of the
inbox, in milliseconds; nothing here reads a clock.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.operators.fold import Lcg
from ledgerloom.operators.replication import majority
from ledgerloom.shipping import ship


def observed_terms(requests: DataFrame) -> DataFrame:
    """Requests with the voter's term after each: the highest that it has seen."""
    w = W.partitionBy("voter_id").orderBy("arrival")
    return requests.withColumn("current_term", F.max("term").over(w.rowsBetween(W.unboundedPreceding, 0)))


def answers(requests: DataFrame) -> DataFrame:
    """What each voter answers to requests (arrival, term, voter_id, candidate_id, candidate_seq, voter_seq), in order:
    STALE_TERM, ALREADY_VOTED, STALE_LOG or GRANTED.

    In a term a voter's vote goes to the candidate of its first request that is neither stale nor behind the voter's
    log; the same candidate may be granted again."""
    seen = observed_terms(requests)
    fit = (F.col("term") == F.col("current_term")) & (F.col("candidate_seq") >= F.col("voter_seq"))
    w = W.partitionBy("voter_id", "term").orderBy("arrival").rowsBetween(W.unboundedPreceding, -1)
    voted = F.first(F.when(fit, F.col("candidate_id")), ignorenulls=True).over(w)
    verdict = F.when(F.col("term") < F.col("current_term"), "STALE_TERM").when(F.col("voted") != F.col("candidate_id"), "ALREADY_VOTED").when(F.col("candidate_seq") < F.col("voter_seq"), "STALE_LOG").otherwise("GRANTED")
    return seen.withColumn("voted", voted).select("arrival", "term", "voter_id", "candidate_id", verdict.alias("answer"))


def tally(answered: DataFrame, nodes: int) -> DataFrame:
    """Votes of each candidate and term; a voter counts once. won: a majority of the cluster."""
    counted = answered.filter("answer = 'GRANTED'").groupBy("term", "candidate_id").agg(F.count_distinct("voter_id").alias("votes"))
    return counted.withColumn("won", F.col("votes") >= majority(nodes))


def first_votes(answered: DataFrame) -> DataFrame:
    """The first vote that each voter grants in a term."""
    w = W.partitionBy("voter_id", "term").orderBy("arrival")
    return answered.filter("answer = 'GRANTED'").withColumn("n", F.row_number().over(w)).filter("n = 1").select("voter_id", "term", "candidate_id", "arrival")


def split_brain(leaders: DataFrame) -> DataFrame:
    """Terms with more than one leader (term, leader): there must be none."""
    return leaders.groupBy("term").agg(F.count_distinct("leader").alias("leaders")).filter("leaders > 1")


def highest(leaders: DataFrame) -> DataFrame:
    """The leaders of the highest term that has one."""
    top = leaders.agg(F.max("term").alias("term"))
    return leaders.join(F.broadcast(top), "term").select("term", "leader").distinct()


class Member:
    """One node of a cluster as a fold of its inbox. step() takes (at, kind, term, peer, granted, log_seq) and returns
    actions (kind, to, term, log_seq, granted).

    Inbox: TICK; REQUEST_VOTE of a candidate; VOTE of a voter; APPEND of a leader; APPEND_RESPONSE of a follower; LOG, which
    tells the node its own head; RESET, a crash that loses term and vote. A higher term in any message makes a follower
    without a vote of whoever sees it."""

    # A leader's pause between heartbeats, and the bounds of a timeout, in milliseconds.
    HEARTBEAT, LOW, HIGH = 50, 150, 300

    def __init__(self, node: int, peers: list[int], seed: int):
        self.node, self.peers, self.random = node, sorted(peers), Lcg(seed)
        self.role, self.term, self.vote, self.leader, self.votes = "FOLLOWER", 0, None, None, set()
        self.log_seq = self.sent = 0
        self._wait(0)

    def _wait(self, at: int) -> None:
        self.heard, self.timeout = at, self.random.within(self.LOW, self.HIGH)

    def _adopt(self, term: int, at: int) -> bool:
        if term <= self.term:
            return False
        self.role, self.term, self.vote, self.leader, self.votes = "FOLLOWER", term, None, None, set()
        self._wait(at)
        return True

    def _lead(self, at: int) -> list[tuple]:
        self.role, self.leader = "LEADER", self.node
        return [("BECAME_LEADER", self.node, self.term, None, None), *self._beat(at)]

    def _beat(self, at: int) -> list[tuple]:
        self.sent = at
        return [("HEARTBEAT", p, self.term, None, None) for p in self.peers]

    def step(self, at: int, kind: str, term: int | None = None, peer: int | None = None, granted: bool | None = None, log_seq: int | None = None) -> list[tuple]:
        return getattr(self, f"_on_{kind.lower()}")(at, term, peer, granted, log_seq)

    def _on_tick(self, at, *_) -> list[tuple]:
        if self.role == "LEADER":
            return self._beat(at) if at - self.sent >= self.HEARTBEAT else []
        if at - self.heard < self.timeout:
            return []
        self.role, self.term, self.vote, self.leader, self.votes = "CANDIDATE", self.term + 1, self.node, None, {self.node}
        self._wait(at)
        if len(self.votes) >= majority(len(self.peers) + 1):
            return self._lead(at)
        return [("REQUEST_VOTE", p, self.term, self.log_seq, None) for p in self.peers]

    def _on_request_vote(self, at, term, peer, _, log_seq) -> list[tuple]:
        self._adopt(term, at)
        free = self.vote in (None, peer)
        grant = term == self.term and free and log_seq >= self.log_seq
        if grant:
            self.vote = peer
            self._wait(at)
        return [("VOTE", peer, self.term, None, grant)]

    def _on_vote(self, at, term, peer, granted, _) -> list[tuple]:
        if self._adopt(term, at) or self.role != "CANDIDATE" or term != self.term or not granted or peer in self.votes:
            return []
        self.votes.add(peer)
        return self._lead(at) if len(self.votes) >= majority(len(self.peers) + 1) else []

    def _on_append(self, at, term, peer, *_) -> list[tuple]:
        if term < self.term:
            return []
        self._adopt(term, at)
        led = self.role == "LEADER"
        self.role, self.leader = "FOLLOWER", peer
        self._wait(at)
        return [("STEPPED_DOWN", self.node, term, None, None)] if led else []

    def _on_append_response(self, at, term, *_) -> list[tuple]:
        return [("STEPPED_DOWN", self.node, term, None, None)] if self._adopt(term, at) else []

    def _on_log(self, at, term, peer, granted, log_seq) -> list[tuple]:
        self.log_seq = log_seq
        return []

    def _on_reset(self, *_) -> list[tuple]:
        self.role, self.term, self.vote, self.leader, self.votes, self.heard, self.sent = "FOLLOWER", 0, None, None, set(), 0, 0
        return []


def actions(inbox: DataFrame, nodes: list[int], seed: int = 1) -> DataFrame:
    """What the nodes of a cluster do on an inbox (node_id, ordinal, at, kind, term, peer, granted, log_seq), each row in
    the order of its node's ordinals: node_id, ordinal, at, action, to, term, log_seq, granted, and the role after it."""
    ship(inbox.sparkSession)
    columns = ("node_id", "ordinal", "at", "kind", "term", "peer", "granted", "log_seq")
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
    names = ("node_id", "ordinal", "at", "action", "to", "term", "log_seq", "granted", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        member = None
        for batch in batches:
            out = []
            for node, ordinal, at, *message in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if member is None or member.node != node:
                    member = Member(node, [n for n in nodes if n != node], seed * 1000 + node)
                out += [(node, ordinal, at, *a, member.role) for a in member.step(at, *message)]
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=list(names))

    typed = inbox.select(*[F.col(c).cast("string" if c == "kind" else "boolean" if c == "granted" else "long").alias(c) for c in columns])
    return typed.repartition("node_id").sortWithinPartitions("node_id", "ordinal").mapInArrow(run, "node_id long, ordinal long, at long, action string, to long, term long, log_seq long, granted boolean, role string")


def timeouts(seed: int, n: int, low: int = Member.LOW, high: int = Member.HIGH) -> list[int]:
    """Randomised election timeouts between two bounds, from the engine's generator."""
    rnd = Lcg(seed)
    return [rnd.within(low, high) for _ in range(n)]
