"""Join of documents whose sets of word n-grams have a Jaccard similarity of at least `percent` / 100.

Equal sets collapse first: what follows works on distinct sets, and copies only share a set's group. Links are found
in tiles. A tile is a size band of sets that share a prefix token: with tokens in one global order, two sets that are
similar enough share one of their first n - ceil(t n) + 1 tokens, and their sizes are in the same band or in adjacent
ones. The order is by hash, but the tokens that are most frequent over all documents come last, so common passages do
not fill tiles. A set also has a bitmap of the parities of its hashed tokens: the bits in which two bitmaps differ are
no more than the tokens in which the sets differ, which bounds the overlap from above. Pairs that pass are verified by
intersecting sorted arrays.

A large group of near copies has a pair for every two members, so pairs are only made where simpler means leave a doubt.
First every set is paired with one pivot of its tile, the one that shares most, and the links that are found are closed to
groups. Sets of tiles that still hold several groups are then gathered around pivots that they are near to, linked or not.
In such a cluster a set is its difference from a reference, and the difference of two sets follows from theirs: if one of
two sets isn't linked with the reference, they can only be linked if their differences share tokens, more of them the
larger they are. So the members are joined on the rarest tokens of their differences, a prefix join once more, in
which the wording that all members have in common plays no part. The reference is the medoid of the cluster; some rounds
take further medoids among the members that are not in the largest group yet. What is left are pairs of a tile that are
neither in one group nor in one cluster: those are compared one by one, all of them, by bitmaps in the join, but rows of the
label that is most frequent in a tile are never compared with each other. Every link is thus either verified or joins
sets that other links already connect: groups are exact.

A document without words, or without a text, is linked with nothing. Repeated doc_ids are rows of their own, and a
null doc_id counts as larger than any other. An empty table gives no rows. Extra columns are ignored, or kept by keep_one().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.llm.columns import NOT_SPACE, Words, mix, ngrams, text_slices
from ledgerloom.llm.components import components
from ledgerloom.llm.store import written
from ledgerloom.shipping import ship

#: How many of the most frequent tokens are broadcast (16 bytes each) to be put last in the order of tokens.
FREQUENT = 200_000
#: The first tokens of a set in the second round that tell whether an earlier one has made a pair.
HEAD = 4
#: Columns of bitmaps folded to 512 bits.
FOLDED = tuple(f"q{k}" for k in range(8))
#: Documents that must share a token for it to count as frequent.
CROWDED = 8
#: Two sets can be in one cluster if the bits in which they differ are at most this share of their sizes' sum.
NEAR = 0.25
#: The most medoids of a cluster that are tried one after another before its members are joined by their differences.
MEDOIDS = 4
#: The most buckets of keys that are broadcast (some 50 bytes each) to pick texts before they are shuffled.
SIEVE = 1 << 19
_BITS = 20
_MEMBER = "hub long, id long, n long, comp long, delta array<long>"


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; a shorter text is one shingle."""
    w = Words(texts, NOT_SPACE)
    h = w.hashes()
    grams, at = ngrams(h, w.first, size)
    bounds = np.searchsorted(at, w.first).tolist()
    out = []
    for d, n in enumerate(w.counts.tolist()):
        if n >= size:
            out.append(np.unique(grams[bounds[d] : bounds[d + 1]]))
        else:
            a = int(w.first[d])
            out.append(ngrams(h[a : a + n], np.array([0, n]), n)[0] if n else np.zeros(0, np.uint64))
    return out


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1 if n else 0


def bitmap(s: np.ndarray) -> np.ndarray:
    """Parities of how many tokens fall on each of 512 to 8192 bits, as 64-bit words."""
    width = min(8192, max(512, 1 << (max(2 * len(s), 1) - 1).bit_length()))
    odd = np.bincount(((s >> np.uint64(20)) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(bounds, np.concatenate([*arrays, np.zeros(0, np.int64)]).astype(np.int64, copy=False))


def _cluster_key(hub: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(mix(hub.astype(np.int64).view(np.uint64)) ^ token.astype(np.int64).view(np.uint64))


def _frequent(docs: DataFrame, size: int, percent: int) -> np.ndarray:
    """The tokens that would fill most tiles, the least frequent of them first.

    Counted are the first tokens by hash of all documents, twice as many as a prefix has: those that could come into a
    prefix once more frequent ones are put last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            sets = shingle_sets(part.column("text"), size)
            tokens, n = np.unique(np.concatenate([s[: 2 * prefix_length(len(s), percent)] for s in sets]), return_counts=True)
            yield pa.record_batch([pa.array(tokens.view(np.int64)), pa.array(n)], names=["token", "n"])

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= CROWDED)
    top = _most(written(counted, "ngram-frequent")).toArrow()
    tokens, n = top.column("token").to_numpy().view(np.uint64), top.column("n").to_numpy()
    return tokens[np.lexsort((tokens, n))]


def _most(counted: DataFrame) -> DataFrame:
    """The rows with the largest n, FREQUENT at most."""
    # the least level of counts above which there are no more than FREQUENT rows; levels are few
    level = F.floor(F.log2("n") * 8).cast("int")
    least, total = 10_000, 0
    for row in sorted(counted.groupBy(level.alias("level")).agg(F.count("*").alias("k")).collect(), reverse=True):
        total += row.k
        if total > FREQUENT:
            break
        least = row.level
    return counted.filter(level >= least)


def described(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, tkey (a hash of the text), n (size of its set), digest, prefix, bits and, folded to 512, FOLDED of every
    document."""
    shared = docs.sparkSession.sparkContext.broadcast(_frequent(docs, size, percent))
    schema = f"doc_id long, tkey long, n long, digest binary, prefix array<long>, bits array<long>, {', '.join(f'{q} long' for q in FOLDED)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = shared.value
        by_hash = np.argsort(last)
        sorted_last = last[by_hash]
        low = np.zeros(1 << _BITS, bool)
        low[(last & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True
        for part in text_slices(batches):
            sets = shingle_sets(part.column("text"), size)
            prefixes, bits = [], []
            for s in sets:
                p = prefix_length(len(s), percent)
                maybe = np.flatnonzero(low[(s & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
                if len(maybe):
                    rank = np.minimum(np.searchsorted(sorted_last, s[maybe]), len(last) - 1)
                    sure = sorted_last[rank] == s[maybe]
                    maybe, rank = maybe[sure], by_hash[rank[sure]]
                if len(maybe):
                    rare = np.delete(s, maybe)
                    prefixes.append(np.concatenate([rare, s[maybe][np.argsort(rank)]])[:p] if len(rare) < p else rare[:p])
                else:
                    prefixes.append(s[:p])
                bits.append(bitmap(s))
            folded = np.array([np.bitwise_xor.reduce(b.reshape(-1, len(FOLDED)), axis=0) for b in bits]).T
            yield pa.record_batch(
                [part.column("doc_id"), part.column("tkey"), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), _lists([x.view(np.int64) for x in prefixes]), _lists(bits), *(pa.array(q) for q in folded)],
                names=["doc_id", "tkey", "n", "digest", "prefix", "bits", *FOLDED],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("tkey"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _several(rows: DataFrame) -> DataFrame:
    """The hubs of clusters that hold several groups."""
    return written(rows.groupBy("hub").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("hub"), "ngram-several")


def _need(na: Column, nb: Column, percent: int) -> Column:
    """The least intersection of sets of these sizes that makes a link."""
    return F.ceil((percent * (na + nb)) / F.lit(100 + percent))


def _differ(a: Column, b: Column) -> Column:
    """Bits in which two bitmaps differ, the wider one folded to the width of the other."""
    fold = lambda x, n: F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.aggregate(F.filter(x, lambda _, i: i % n == k), F.lit(0).cast("long"), lambda acc, y: acc.bitwiseXOR(y)))
    n = F.least(F.size(a), F.size(b))
    to = lambda x: F.when(F.size(x) > n, fold(x, n)).otherwise(x)
    return F.aggregate(F.zip_with(to(a), to(b), lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda acc, y: acc + y)


class Join:
    """links(): the groups of all documents; the steps are written to the shared folder as they are made."""

    def __init__(self, docs: DataFrame, size: int = 4, percent: int = 85):
        ship(docs.sparkSession)
        self.docs, self.size, self.percent = docs, size, percent
        self.rows = written(described(docs, size, percent), "ngram-rows")
        sets = self.rows.filter("n > 0").groupBy("digest").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tkey")).alias("rep"), *[F.first(c).alias(c) for c in ("n", "prefix", "bits", *FOLDED)]
        )
        self.sets = written(sets.select(F.monotonically_increasing_id().alias("id"), "digest", "rep", "n", "prefix", "bits", *FOLDED), "ngram-sets")

    def _band(self) -> Column:
        # a band is a little wider than the least ratio of sizes, so rounding can't part similar sizes by two bands
        return F.floor(F.log("n") / F.log(F.lit(100 / self.percent * 1.001))).cast("int").alias("band")

    def _tiles(self) -> DataFrame:
        """(token, band, id, n, pos, degree) of prefix tokens that two or more sets share; the degree of a set is how many
        sets share its prefix tokens, for its size."""
        one = self.sets.select("id", "n", F.posexplode("prefix").alias("pos", "token"))
        shared = self.sets.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("k")).filter("k > 1")
        degree = F.sum("k").over(W.partitionBy("id")) / F.col("n")
        return written(one.join(shared, "token").select("token", self._band(), "id", "n", "pos", degree.alias("degree")), "ngram-tiles")

    def _shingles(self, ids: DataFrame) -> DataFrame:
        """(id, shingles) of these sets, from the text of one document of each.

        Only texts whose key falls on one of at most SIEVE broadcast buckets are shuffled."""
        size = self.size
        wanted = written(self.sets.join(ids, "id", "left_semi").select("id", F.col("rep.doc_id").alias("rep_id"), F.col("rep.tkey").alias("rep_key"), "digest"), "ngram-wanted")
        m = min(SIEVE, max(1024, 8 * wanted.count()))
        buckets = F.broadcast(wanted.select(F.pmod("rep_key", F.lit(m)).alias("bucket")).distinct())
        texts = self.docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("tkey"), F.col("text").cast("string").alias("text"))
        texts = texts.join(buckets, F.pmod("tkey", F.lit(m)) == F.col("bucket"), "left_semi")
        found = texts.join(wanted, (F.coalesce("doc_id", F.lit(-1)) == F.coalesce("rep_id", F.lit(-1))) & (F.col("tkey") == F.col("rep_key"))).select("id", "digest", "text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in text_slices(batches):
                raw = [s.tobytes() for s in shingle_sets(part.column("text"), size)]
                same = [hashlib.blake2b(x, digest_size=16).digest() == d for x, d in zip(raw, part.column("digest").to_pylist(), strict=True)]
                yield pa.record_batch([part.column("id"), pa.array(raw, pa.binary())], names=["id", "shingles"]).filter(pa.array(same))

        return written(found.mapInArrow(run, "id long, shingles binary"), "ngram-shingles")

    def _compared(self, pairs: DataFrame) -> DataFrame:
        """Adds na, nb and differ, the bits in which the bitmaps differ, to distinct pairs (a, b)."""
        side = lambda s: self.sets.select(F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col("bits").alias(f"bits{s}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        return both.select("a", "b", "na", "nb", _differ(F.col("bitsa"), F.col("bitsb")).alias("differ"))

    def _possible(self) -> Column:
        """Whether compared pairs can be linked, by their sizes and bitmaps."""
        na, nb = F.col("na"), F.col("nb")
        return (100 * F.least(na, nb) >= self.percent * F.greatest(na, nb)) & (F.col("differ") <= na + nb - 2 * _need(na, nb, self.percent))

    def _verified(self, bounded: DataFrame, name: str) -> DataFrame:
        """The links (a, b) among pairs (a, b), by intersecting their shingles."""
        percent = self.percent
        bounded = written(bounded.select("a", "b"), f"{name}-pairs")
        if not bounded.take(1):
            return bounded
        shingles = self._shingles(bounded.select(F.col("a").alias("id")).distinct().unionAll(bounded.select(F.col("b").alias("id")).distinct()).distinct())
        of = lambda s: shingles.select(F.col("id").alias(s), F.col("shingles").alias(f"s{s}"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                linked = []
                for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                    x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    linked.append(100 * both >= percent * (len(x) + len(y) - both))
                yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

        return written(bounded.join(of("a"), "a").join(of("b"), "b").mapInArrow(run, "a long, b long"), f"{name}-links")

    def _clusters(self, near: DataFrame, left: DataFrame, group: DataFrame) -> DataFrame:
        """(hub, id, n, comp) of the sets of open tiles, each with the one pivot near to it that most are near to; only
        clusters that hold several groups."""
        ids = left.select("id").distinct()
        votes = near.select(F.col("a").alias("id"), F.col("b").alias("hub")).join(ids, "id", "left_semi")
        # counts of clusters are written first: a small table is then broadcast and rows of a hot cluster stay where they are
        weighed = votes.join(written(votes.groupBy("hub").agg(F.count("*").alias("votes")), "ngram-votes"), "hub")
        chosen = written(weighed.groupBy("id").agg(F.max_by("hub", F.struct("votes", "hub")).alias("hub")), "ngram-chosen")
        hubs = chosen.select("hub").distinct()
        own = hubs.select(F.col("hub").alias("id"), "hub")
        named = chosen.join(own.select("id"), "id", "left_anti").unionByName(own).join(group, F.col("id") == F.col("node"), "left")
        named = named.select("hub", "id", F.coalesce("component", "id").alias("comp"))
        named = written(named, "ngram-named")
        return written(named.join(_several(named), "hub", "left_semi").join(self.sets.select("id", "n"), "id").select("hub", "id", "n", "comp"), "ngram-clusters")

    def _differences(self, members: DataFrame) -> DataFrame:
        """Adds delta to members: the shingles of the set or of the set `hub`, but not of both."""
        shingles = self._shingles(members.select("id").distinct())
        both = members.join(shingles, "id").join(shingles.select(F.col("id").alias("hub"), F.col("shingles").alias("other")), "hub")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pairs = zip(batch.column("shingles"), batch.column("other"), strict=True)
                deltas = [np.setxor1d(*(np.frombuffer(v.as_buffer(), np.int64) for v in p), assume_unique=True) for p in pairs]
                yield pa.record_batch([*(batch.column(c) for c in ("hub", "id", "n", "comp")), _lists(deltas)], names=["hub", "id", "n", "comp", "delta"])

        return written(both.select("hub", "id", "n", "comp", "shingles", "other").mapInArrow(run, _MEMBER), "ngram-differences")

    def _common(self, members: DataFrame) -> np.ndarray:
        """Keys of the tokens that most differences of a cluster have, and the shares of its members that have them."""
        counted = members.select("hub", F.explode("delta").alias("token")).groupBy("hub", "token").agg(F.count("*").alias("n")).filter(F.col("n") >= CROWDED)
        top = _most(written(counted, "ngram-common")).join(members.groupBy("hub").agg(F.count("*").alias("m")), "hub")
        top = top.select("hub", "token", (F.col("n") / F.col("m")).alias("share")).toArrow()
        keys, share = _cluster_key(top.column("hub").to_numpy(), top.column("token").to_numpy()), top.column("share").to_numpy()
        order = np.argsort(keys, kind="stable")
        return np.rec.fromarrays([keys[order], share[order]], names="key,share")

    def _ordered(self, members: DataFrame, common: np.ndarray) -> DataFrame:
        """Members with the tokens of their differences in the order of how common they are, and `score`: the smaller,
        the nearer to all others."""
        shared = members.sparkSession.sparkContext.broadcast(common)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                delta = batch.column("delta")
                tokens, sizes = delta.flatten().to_numpy(), delta.value_lengths().to_numpy()
                row = np.repeat(np.arange(len(sizes)), sizes)
                share = np.zeros(len(tokens))
                if len(shared.value) and len(tokens):
                    keys = _cluster_key(np.repeat(batch.column("hub").to_numpy(), sizes), tokens)
                    at = np.minimum(np.searchsorted(shared.value.key, keys), len(shared.value) - 1)
                    share = np.where(shared.value.key[at] == keys, shared.value.share[at], 0)
                score = sizes - 2 * np.bincount(row, share, minlength=len(sizes))
                ordered = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), tokens[np.lexsort((tokens, share, row))])
                yield pa.record_batch([*(batch.column(c) for c in ("hub", "id", "n", "comp")), ordered, pa.array(score, pa.float64())], names=["hub", "id", "n", "comp", "delta", "score"])

        return members.select("hub", "id", "n", "comp", "delta").mapInArrow(run, f"{_MEMBER}, score double")

    def _within(self, members: DataFrame) -> DataFrame:
        """The links (a, b) of members of one cluster that are in different groups, or that connect what these links do."""
        percent = self.percent
        members = self._differences(members)
        found = None
        for k in range(MEDOIDS):
            size = members.groupBy("hub", "comp").agg(F.count("*").alias("k"))
            largest = written(size.groupBy("hub").agg(F.max_by("comp", F.struct("k", "comp")).alias("largest")), "ngram-largest")
            rest = members if k == 0 else written(members.join(largest, "hub").filter("comp <> largest").drop("largest"), "ngram-rest")
            scored = self._ordered(rest, self._common(rest))
            medoids = written(scored.groupBy("hub").agg(F.min_by(F.struct("id", "n", "comp", "delta"), F.struct("score", "id")).alias("m")), "ngram-medoids")
            away = members.join(medoids, "hub")
            other = F.col("m.delta")
            moved = F.concat(F.array_except("delta", other), F.array_except(other, F.col("delta"))).alias("moved")
            # linked if the difference is at most (100 - percent) / (100 + percent) of the sizes' sum
            linked = (100 + percent) * F.size("moved") <= (100 - percent) * (F.col("n") + F.col("m.n"))
            away = written(away.select("hub", "id", "n", "comp", "delta", "m", moved).select("*", linked.alias("linked")), "ngram-moved")
            new = away.filter("linked and comp <> m.comp").select(F.col("id").alias("a"), F.col("m.id").alias("b"), F.col("comp").alias("ca"), F.col("m.comp").alias("cb"))
            found = new.select("a", "b") if found is None else found.unionAll(new.select("a", "b"))
            reference = away if k == 0 else reference
            merged = written(components(new.select(F.col("ca").alias("a"), F.col("cb").alias("b"))), "ngram-merged")
            members = written(members.join(merged, members["comp"] == merged["node"], "left").select("hub", "id", "n", F.coalesce("component", "comp").alias("comp"), "delta"), "ngram-members")
            before, after = (x.select("hub", "comp").distinct().count() for x in (away, members))
            # a further medoid is worth its pass over the members while one in eight of the groups goes
            if after > 0.875 * before:
                break
        # the differences from the first medoids, with the groups as they are now
        now = members.select("id", F.col("comp").alias("now"))
        moved = reference.join(now, "id").select("hub", "id", "n", F.col("now").alias("comp"), F.col("moved").alias("delta"), F.col("m.n").alias("nh"), "linked")
        moved = written(moved, "ngram-moved")
        moved = written(moved.join(_several(moved), "hub", "left_semi"), "ngram-moved")
        ordered = self._ordered(moved, self._common(moved)).drop("score").join(moved.select("id", "nh", "linked"), "id")
        ordered = written(ordered.select("*", F.size("delta").cast("long").alias("d")), "ngram-ordered")
        n, d, nh = F.col("n"), F.col("d"), F.col("nh")
        up, down = 100 + percent, 100 - percent
        # the least overlap of differences with a member that isn't linked with the medoid, and of such a member with any
        with_far = F.floor((up * d + down * (nh - n)) / F.lit(2 * up)) + 1
        of_far = F.ceil((up * d + 2 * percent - down * (n + nh)) / F.lit(2 * up))
        def tokens(rows: DataFrame, least: Column, s: str) -> DataFrame:
            prefix = F.slice("delta", F.lit(1), F.greatest(d - F.greatest(least, F.lit(1)) + 1, F.lit(0)).cast("int"))
            one = rows.select("hub", "id", "n", "comp", "d", "linked", F.posexplode(prefix).alias("pos", "token"))
            return one.select("hub", "token", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "comp", "d", "linked", "pos")])

        far, all_ = tokens(ordered.filter("not linked"), of_far, "1"), tokens(ordered, with_far, "2")
        differ = F.floor(down * (F.col("n_1") + F.col("n_2")) / F.lit(up))
        overlap = F.ceil((F.col("d_1") + F.col("d_2") - differ) / F.lit(2))
        pairs = far.join(all_, ["hub", "token"]).filter(
            (F.col("comp_1") != F.col("comp_2")) & (F.col("linked_2") | (F.col("id_1") < F.col("id_2")))
            & (F.least(F.col("d_1") - F.col("pos_1"), F.col("d_2") - F.col("pos_2")) >= overlap)
        )
        pairs = written(pairs.select(F.col("id_1").alias("a"), F.col("id_2").alias("b"), overlap.alias("overlap")).distinct(), "ngram-within-pairs")
        side = lambda s: ordered.select(F.col("id").alias(s), F.col("delta").alias(f"delta{s}"))
        same = F.size(F.array_intersect("deltaa", "deltab")) >= F.col("overlap")
        return found.unionAll(pairs.join(side("a"), "a").join(side("b"), "b").filter(same).select("a", "b"))

    def _across(self, left: DataFrame) -> DataFrame:
        """Pairs (a, b) of open tiles that differ in group and label and may be linked by place, size and folded bitmaps."""
        percent = self.percent
        counted = left.groupBy("token", "label").agg(F.count("*").alias("k"))
        most = counted.groupBy("token").agg(F.max_by("label", F.struct("k", "label")).alias("most"), F.count("*").alias("labels")).filter("labels > 1")
        left = left.join(most, "token").withColumn("minor", F.col("label") != F.col("most")).join(self.sets.select("id", *FOLDED), "id")
        # the bound of the folded bitmaps is part of the join's condition, so pairs beyond it are not made; nor is a pair
        # that a token earlier in both orders makes: each row has its rank among the rows of its set here, and the first tokens
        mine = W.partitionBy("id").orderBy("pos")
        whole = mine.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        left = left.select("*", F.row_number().over(mine).alias("rank"), *[F.nth_value("token", k + 1).over(whole).alias(f"h{k}") for k in range(HEAD)])
        left = written(left, "ngram-labelled")
        cols = ("id", "n", "pos", "comp", "label", *FOLDED, "rank", *(f"h{k}" for k in range(HEAD)))
        small = left.select("token", "band", "minor", *[F.col(c).alias(f"{c}_1") for c in cols])
        large = left.select("token", F.explode(F.array("band", F.col("band") - 1)).alias("band"), "minor", *[F.col(c).alias(f"{c}_2") for c in cols])
        one, two = ({c: F.col(f"{c}_{k}") for c in cols} for k in (1, 2))
        n1, n2 = one["n"], two["n"]
        need = _need(n1, n2, percent)
        differ, made = F.lit(0), F.lit(False)
        for q in FOLDED:
            differ = differ + F.bit_count(one[q].bitwiseXOR(two[q]))
        for i in range(HEAD):
            for j in range(HEAD):
                made = made | (one[f"h{i}"].eqNullSafe(two[f"h{j}"]) & (one["rank"] > i + 1) & (two["rank"] > j + 1))
        may = (
            (one["comp"] != two["comp"]) & (one["label"] != two["label"]) & ((n1 < n2) | ((n1 == n2) & (one["id"] < two["id"]))) & (100 * n1 >= percent * n2)
            & (F.least(n1 - one["pos"], n2 - two["pos"]) >= need) & ~made & (differ <= n1 + n2 - 2 * need)
        )
        met = lambda x, y: x.drop("minor").join(y.drop("minor"), ["token", "band"]).filter(may).select(F.col("id_1").alias("a"), F.col("id_2").alias("b"))
        return met(small.filter("minor"), large).unionAll(met(small.filter("not minor"), large.filter("minor"))).distinct()

    def groups(self) -> DataFrame:
        """(digest, component, keeper): the smallest doc_id of each set's group, and the row that stands for the group."""
        tiles = self._tiles()
        pivots = tiles.groupBy("token", "band").agg(F.max_by("id", F.struct("degree", "id")).alias("pivot"))
        beside = pivots.unionAll(pivots.withColumn("band", F.col("band") + 1))
        first = tiles.join(beside, ["token", "band"]).filter(F.col("id") != F.col("pivot")).select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()
        sizes = F.col("na") + F.col("nb")
        near = F.greatest(F.col("differ"), F.abs(F.col("na") - F.col("nb"))) <= max(NEAR, (100 - self.percent) / (100 + self.percent)) * sizes
        near = written(self._compared(first).filter(near), "ngram-near")
        links = self._verified(near.filter(self._possible()), "ngram-first")
        group = components(links)
        named = tiles.join(group, tiles["id"] == group["node"], "left").select("token", "id", "n", "band", "pos", F.coalesce("component", "id").alias("comp"))
        # of two sets one is the other's pivot, so a tile with no more than two is done
        open_ = named.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("k")).filter("lo <> hi and k > 2").select("token")
        left = written(named.join(open_, "token", "left_semi"), "ngram-open")
        clusters = self._clusters(near, left, group)
        if clusters.take(1):
            within = written(self._within(clusters), "ngram-within")
            links = links.unionAll(within)
            group = components(links)
        hubs = clusters.select("id", "hub")
        # a label is a cluster or a group: pairs of one label are settled
        labelled = left.drop("comp").join(group, F.col("id") == F.col("node"), "left").join(hubs, "id", "left")
        comp = F.coalesce("component", "id")
        labelled = labelled.select("token", "id", "n", "band", "pos", comp.alias("comp"), F.coalesce(-F.col("hub") - 1, comp).alias("label"))
        second = written(self._across(labelled), "ngram-across")
        links = links.unionAll(self._verified(self._compared(second).filter(self._possible()), "ngram-second"))
        group = components(links)
        member = self.sets.join(group, self.sets["id"] == group["node"], "left").select("digest", "rep", F.coalesce("component", "id").alias("comp"))
        least = member.groupBy("comp").agg(F.min("rep").alias("keeper"))
        return written(member.join(least, "comp").select("digest", F.col("keeper.doc_id").alias("component_id"), "keeper"), "ngram-groups")


def join(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (the smallest doc_id that links reach, its own included)."""
    found = Join(docs, size, percent)
    rows, groups = found.rows.select("doc_id", "n", "digest"), found.groups().select("digest", "component_id")
    empty = rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return rows.filter("n > 0").join(groups, "digest").select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionAll(empty)


def keep_one(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """One document of each group, that with the smallest doc_id, with its columns; documents without words all stay."""
    found = Join(docs, size, percent)
    keepers = found.groups().select(F.col("keeper.doc_id").alias("keep_id"), F.col("keeper.tkey").alias("keep_key")).distinct()
    empty = found.rows.filter("n = 0").select(F.col("doc_id").alias("keep_id"), F.col("tkey").alias("keep_key")).distinct()
    keepers = keepers.withColumn("one", F.lit(True)).unionAll(empty.withColumn("one", F.lit(False)))
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row_"), F.col("doc_id").cast("long").alias("id_"), F.xxhash64(F.col("text").cast("string")).alias("key_"))
    joined = rows.join(keepers, (F.coalesce("id_", F.lit(-1)) == F.coalesce("keep_id", F.lit(-1))) & F.col("id_").eqNullSafe(F.col("keep_id")) & (F.col("key_") == F.col("keep_key")))
    # repeated rows of a keeper are copies of each other
    ones = joined.filter("one").dropDuplicates(["id_", "key_"]).unionAll(joined.filter("not one"))
    return ones.select(*[F.col(f"row_.`{c}`").alias(c) for c in docs.columns])
