"""Token files, packing, decontamination, n-gram join, pipeline: exact round trips and brute force."""

import collections
import hashlib
import io
import random
import re
import zlib

import numpy as np
import pytest
from ledgerloom.llm import decontaminate, decontaminate_large, ngram_join, packing, quality_rules, registry, secrets, token_files
from ledgerloom.llm.store import new_path
from pyspark.sql import functions as F
from tests_llm import same_sql, table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def plain(name):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    return public.path(name), Tokenizer.from_file(public.path(name))


def ids_of(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


# files


def test_files_round_trip(spark, hard, texts):
    path, tokenizer = plain("word_bpe_49k.json")
    folder = new_path(spark, "files")
    manifest = token_files.write(hard, folder, path, shards=3, frame_ids=500)
    assert len(manifest) == 3
    got = sorted(((r.start, r.doc_id, r.n_tokens, bytes(r.ids)) for r in token_files.read(spark, manifest, folder, group=900).collect()), key=lambda r: r[0])
    want, start = [], 0
    for k, t in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode())):
        ids = ids_of(tokenizer, t)
        want.append((start, k, len(ids), ids.tobytes()))
        start += len(ids)
    assert got == want


def test_empty_files(spark, none):
    path, _ = plain("word_bpe_49k.json")
    folder = new_path(spark, "files")
    assert token_files.write(none, folder, path) == [] and token_files.read(spark, [], folder).count() == 0


class Counted(io.BytesIO):
    read_bytes = 0

    def size(self):
        return len(self.getvalue())

    def read(self, n=-1):
        self.read_bytes += n
        return super().read(n)


def test_readers_decompress_only_what_they_need():
    out = io.BytesIO()
    writer = token_files.Writer(out, frame_ids=1000, directory_docs=2)
    rnd = np.random.default_rng(1)
    docs = [rnd.integers(0, 50_000, n).astype(np.uint32) for n in (1, 5000, 10, 999, 1001, 3)]
    for k, ids in enumerate(docs):
        writer.add([k if k != 2 else None], ids, np.array([0, len(ids)]))
    writer.close()
    source = Counted(out.getvalue())
    reader = token_files.Reader(source)
    before = source.read_bytes
    assert reader.documents(5)[0].tolist() == docs[5].tolist()
    used = [int(reader.data[-1]), *reader.index[:, 0].tolist()[-1:]]
    assert source.read_bytes - before <= reader.packed[used].sum() + reader.packed[reader.data[-2]]  # its directory and one frame, or two
    assert len(reader.index) == 3 and len(reader.data) == 8 and max(len(d.doc_ids) for d in reader.directories()) == 2
    assert [reader.documents(k if k != 2 else None)[0].tolist() for k in range(6)] == [d.tolist() for d in docs]
    assert reader.documents(77) == []


def test_damage_is_noticed():
    out = io.BytesIO()
    writer = token_files.Writer(out, frame_ids=100)
    writer.add([1, 2], np.arange(500, dtype=np.uint32), np.array([0, 100, 500]))
    writer.close()
    data = bytearray(out.getvalue())
    import zstandard

    whole = b"".join(zstandard.ZstdDecompressor().decompressobj().decompress(bytes(data[a:b])) for a, b in _frames(bytes(data)))
    assert whole[:2000] == np.arange(500, dtype="<u4").tobytes()  # any zstandard tool reads the frames
    reader = token_files.Reader(Counted(bytes(data)))
    data[int(reader.packed[0]) - 3] ^= 0x40
    with pytest.raises(ValueError, match="frame 0"):
        token_files.Reader(Counted(bytes(data))).documents(1)
    # a frame that is sound for zstandard but has other content: only the checksum tells
    other = zstandard.ZstdCompressor(level=3, write_content_size=True).compress(np.arange(1, 101, dtype="<u4").tobytes())
    whole, table = bytearray(out.getvalue()), reader.places
    changed = bytearray(other + whole[int(table[1]) :])
    begin = len(changed) - 9 - 12 * len(reader.packed)
    changed[begin : begin + 4] = len(other).to_bytes(4, "little")
    with pytest.raises(ValueError, match="checksum of frame 0"):
        token_files.Reader(Counted(bytes(changed))).documents(1)
    with pytest.raises(ValueError, match="no seek table"):
        token_files.Reader(Counted(bytes(data[:-1])))


def _frames(data):
    reader = token_files.Reader(Counted(data))
    return list(zip(reader.places[:-1].tolist(), reader.places[1:].tolist(), strict=True))


# packing


def padding(used):
    return sum(0 if n & (n - 1) == 0 else 2048 - n for n in used)


@pytest.mark.parametrize("seed", range(12))
def test_assignment(seed):
    rnd = np.random.default_rng(seed)
    lengths = np.minimum(2047, (rnd.pareto(1.1, rnd.integers(1, 800)) * 60).astype(int) + 1) if seed % 3 else rnd.integers(1, 2048, rnd.integers(1, 400))
    pieces = packing.assign(lengths.astype(np.int64), 2048)
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for d, start, n, s, offset in pieces:
        by_doc[d].append((start, n))
        by_seq[s].append((offset, n))
    for d, n in enumerate(lengths.tolist()):
        at = 0
        for start, k in sorted(by_doc[d]):
            assert start == at and k > 0
            at += k
        assert at == n
    used = []
    for s in range(len(by_seq)):
        at = 0
        for offset, n in sorted(by_seq[s]):
            assert offset == at
            at += n
        assert at <= 2048
        used.append(at)
    if lengths.sum() > 50_000:
        assert padding(used) <= 0.01 * lengths.sum()


def test_costs_are_balanced():
    rnd = np.random.default_rng(5)
    lengths = rnd.integers(20, 400, 2000)
    cost = collections.Counter()
    naive = collections.Counter()
    at = 0
    for _, _, n, s, _ in packing.assign(lengths, 2048):
        cost[s] += n + n * n / 2048
    for n in lengths.tolist():  # the order of arrival
        naive[at // 2048] += n + n * n / 2048
        at += n
    full = [v for v in cost.values() if v > 1000]
    assert np.std(full) < 0.5 * np.std(list(naive.values()))
    assert packing.assign(np.zeros(0, np.int64), 2048) == []


def test_short_documents_leave_little_padding():
    rnd = np.random.default_rng(5)
    for lengths in ([300, 300, 300], [100] * 7, [1], [130] * 40, *(rnd.integers(1, rnd.integers(2, 400), rnd.integers(1, 60)) for _ in range(200))):
        used, held = collections.Counter(), collections.Counter()
        for d, start, n, s, offset in packing.assign(np.array(lengths, np.int64), 2048):
            assert n > 0 and offset == used[s]
            used[s] += n
            held[d] += n
        assert [held[d] for d in range(len(lengths))] == list(lengths)
        assert sum(max(128, 1 << (n - 1).bit_length()) - n for n in used.values()) < 128


def check_packing(rows, texts, tokenizer):
    want = collections.Counter((k, ids_of(tokenizer, t).tobytes()) for k, t in texts)
    by_seq = collections.defaultdict(list)
    pieces = collections.defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id, r.doc_tokens].append((r.start, bytes(r.ids)))
        assert len(r.ids) == 4 * r.length
    for found in by_seq.values():
        at = 0
        for offset, n in sorted(found):
            assert offset == at
            at += n
        assert at <= 2048
    whole = {k: b"".join(x for _, x in sorted(v)) for k, v in pieces.items()}
    for (k, ids), n in want.items():
        got = whole[k, len(ids) // 4]
        if n == 1 and sum(1 for (a, b) in want if a == k and len(b) == len(ids)) == 1:
            assert got == ids
        assert len(got) == len(ids) * sum(m for (a, b), m in want.items() if a == k and len(b) == len(ids))


def test_packing(hard, texts, none):
    path, tokenizer = plain("byte_bpe_50k.json")
    check_packing(packing.pack(hard, path, block_tokens=4000).collect(), texts, tokenizer)
    check_packing(packing.pack(hard, path, block_docs=3).collect(), texts, tokenizer)
    assert packing.pack(none, path).count() == 0


# decontamination


def test_decontamination_matches_its_sql(spark, sf_dir):
    same_sql(spark, sf_dir, "op4_decontamination")


def contamination(docs, items):
    windows = collections.defaultdict(set)
    for k, t in items:
        w = re.findall(WORD, lower(t))
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[i : i + n])].add(str(k) if k is not None else "null")
    out = collections.Counter()
    for k, t in docs:
        w, hit, found = re.findall(WORD, lower(t)), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if x := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= x
        out[k, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)] += 1
    return out


@pytest.mark.parametrize("block", [32 << 20, 400])
def test_decontamination(spark, hard, texts, block):
    long = next(t for _, t in texts if t and 40 < len(t.split()) < 100)
    items = [(1, " ".join(long.split()[5:30])), (2, "one-two, three"), (3, "Lazy"), (4, None), (5, " ... "), (6, "the the the"), (7, "word " * 13), (None, "owls watch from tall"), (10, "Lazy"), (3, "mill"), (11, "word " * 20)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = contamination(texts, items)
    found = decontaminate.hits(hard, benchmark, block_bytes=block)
    got = collections.Counter((r.doc_id, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.contaminated) for r in found.select("row_.doc_id", "n_words", "n_hit", "items", "contaminated").collect())
    assert got == want
    kept = decontaminate.keep_clean(hard, benchmark)
    assert kept.schema == hard.schema and kept.count() == sum(n for k, n in want.items() if not k[-1])


@pytest.mark.parametrize("most_bits", [6, 29])
def test_large_benchmarks_give_the_same(spark, sf_dir, most_bits, monkeypatch):
    """The join of tables gives what the broadcast index gives, spans and items, also if its bit tables let everything through."""
    docs, benchmark = (registry.table(spark, sf_dir, n) for n in ("documents", "benchmark"))
    monkeypatch.setattr(decontaminate_large, "MOST_BITS", most_bits)
    rows = [sorted((r.row_.doc_id, r.n_words, str(r.spans), str(r["items"]), r.n_hit, r.contaminated) for r in decontaminate.hits(docs, benchmark, block_bytes=n).collect()) for n in (32 << 20, 0)]
    assert rows[0] == rows[1] and any(r[-1] for r in rows[0])


def test_large_benchmarks_take_a_fixed_number_of_passes(spark, hard, sf_dir, monkeypatch):
    """Items cut, shingled, shingles counted, places found, words counted: five passes in Arrow for any benchmark."""
    small = registry.table(spark, sf_dir, "benchmark")
    kind, calls = type(hard), []
    run = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, *a, **k: calls.append(self.columns) or run(self, *a, **k))
    seen = []
    for benchmark in (small, small.union(small.withColumn("text", F.concat("text", F.lit(" and more"))))):
        calls.clear()
        decontaminate.hits(hard, benchmark, block_bytes=0)
        seen.append(len(calls))
    assert seen == [5, 5]


def test_decontamination_of_nothing(hard, none, spark):
    benchmark = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.summary(none, benchmark).count() == 0
    assert decontaminate.summary(hard, benchmark.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.keep_clean(hard, benchmark.filter("item_id > 1")).count() == hard.count()


# n-gram join


def grams(t, size=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < size else frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def groups(texts):
    sets = [grams(t) for _, t in texts]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    for n, i in enumerate(order):
        for j in order[n + 1 :] if sets[i] else ():
            if 100 * len(sets[i]) < 85 * len(sets[j]):
                break
            both = len(sets[i] & sets[j])
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    return sets, [find(i) for i in range(len(sets))]


def near_copies(n, seed):
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(400)}" for _ in range(60)]
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(50)}"
        out.append((10_000 * seed + k, " ".join(w[rnd.randint(0, 2) : len(w) - rnd.randint(0, 2)]), "en", "a", 0))
    return out


def test_join_matches_its_sql(spark, sf_dir):
    same_sql(spark, sf_dir, "op9_ngram_join")


@pytest.mark.parametrize("frequent", [200_000, 5])
def test_join_finds_all_groups(spark, hard, texts, monkeypatch, frequent):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    more = near_copies(150, 1) + near_copies(80, 2)
    docs = hard.select("doc_id", "text", "lang", "source", "n_chars").unionAll(spark.createDataFrame(more, SCHEMA))
    all_texts = [*texts, *((k, t) for k, t, *_ in more)]
    sets, root = groups(all_texts)
    members = collections.defaultdict(list)
    for (k, _), r in zip(all_texts, root, strict=True):
        members[r].append(k)
    want = collections.Counter((k, len(s), min((x for x in members[r] if x is not None), default=None)) for (k, _), s, r in zip(all_texts, sets, root, strict=True))
    got = collections.Counter(tuple(r) for r in ngram_join.join(docs).select("doc_id", "n_shingles", "component_id").collect())
    assert got == want
    if frequent == 5:
        return
    # empty documents are linked with nothing, not even with their repetitions
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len({r for s, r in zip(sets, root, strict=True) if s}) + sum(not s for s in sets)


def fuzzy(n, seed, words=70, most=9):
    """Copies of one text of which each has some words of its own: some link, most do not, and chains run through them."""
    rnd = random.Random(seed)
    base = [f"b{rnd.randrange(500)}" for _ in range(words)]
    out = []
    for k in range(n):
        w = list(base)
        for at in rnd.sample(range(words), rnd.randint(0, most)):
            w[at] = f"y{rnd.randrange(3000)}"
        out.append((50_000 * seed + k, " ".join(w), "en", "a", 0))
    return out


@pytest.mark.parametrize(("crowded", "medoids", "near"), [(8, 4, 0.25), (2, 1, 0.09), (10_000, 2, 0.5)])
def test_fuzzy_groups_keep_all_links(spark, monkeypatch, crowded, medoids, near):
    """Groups of which the members link through others only, whatever clusters and medoids there are."""
    for k, v in (("CROWDED", crowded), ("MEDOIDS", medoids), ("NEAR", near)):
        monkeypatch.setattr(ngram_join, k, v)
    drift, w = [], [f"d{k}" for k in range(80)]
    for k in range(60):  # each is near to the one before, the first and the last have nothing in common
        w[(7 * k) % 80] = f"e{k}"
        drift.append((900_000 + (k * 37) % 60, " ".join(w), "en", "a", 0))
    rows = fuzzy(220, 3, words=300, most=6) + fuzzy(120, 4) + drift + near_copies(60, 5)
    sets, root = groups([(k, t) for k, t, *_ in rows])
    least = {}
    for (k, *_), r in zip(rows, root, strict=True):
        least[r] = min(k, least.get(r, k))
    got = {r.doc_id: r.component_id for r in ngram_join.join(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {k: least[r] for (k, *_), r in zip(rows, root, strict=True)}
    assert len(set(root)) > 40 and max(collections.Counter(root).values()) >= 60


def test_join_keeps_columns(hard, none):
    assert ngram_join.join(none).count() == 0
    empty = ngram_join.keep_one(none)
    assert empty.count() == 0 and empty.schema == hard.schema


def test_bitmaps_bound_differences(spark):
    rnd = np.random.default_rng(3)
    rows = []
    for _ in range(60):
        n = int(rnd.integers(1, 3000))
        a = np.unique(rnd.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rnd.random(len(a)) < rnd.random()], rnd.integers(0, 2**63, int(rnd.integers(1, 900)), dtype=np.uint64)]))
        rows.append((ngram_join.bitmap(a).tolist(), ngram_join.bitmap(b).tolist(), len(np.setxor1d(a, b)), ngram_join.bitmap(a).tolist()))
    df = spark.createDataFrame(rows, "a array<long>, b array<long>, d long, c array<long>")
    for r in df.select(ngram_join._differ(F.col("a"), F.col("b")).alias("x"), "d", ngram_join._differ(F.col("a"), F.col("c")).alias("same")).collect():
        assert r.x <= r.d and r.same == 0


# pipeline


def test_pipeline_against_brute_force(spark, sf_dir):
    import corpus_pipeline

    _, tokenizer = plain("byte_bpe_50k.json")
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    docs = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    kept = {r.doc_id for r in quality_rules.verdicts(table(spark, sf_dir, "documents")).filter("kept").collect()}
    left = [(k, docs[k]) for k in sorted(kept)]
    _, root = groups(left)
    first = {}
    for (k, _), r in zip(left, root, strict=True):
        first.setdefault(r, k)
    left = [(k, docs[k]) for k in sorted(first.values())]
    dirty = contamination(left, [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()])
    left = [(k, t) for k, t in left if k not in {x[0] for x in dirty if x[-1]}]
    clean = {r.doc_id: r.text for r in secrets.redact(spark.createDataFrame(left, "doc_id long, text string")).collect()}
    assert 0 < len(clean) < len(docs) and sum("[SECRET]" in t for t in clean.values()) > 0
    check_packing(rows, list(clean.items()), tokenizer)
    assert {r.doc_id for r in rows} == set(clean)


def test_stages_keep_columns(spark, sf_dir):
    import corpus_pipeline

    docs = table(spark, sf_dir, "documents").withColumns({"words": F.lit("x"), "row_": F.lit(1), "dotted.name": F.lit(2)})
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()


def test_redaction_covers_base_secrets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    again = secrets.summary(secrets.redact(docs)).agg(F.sum(F.col("n_assign") + F.col("n_access") + F.col("n_hex")).alias("n")).first().n
    assert again == 0 and zlib.crc32(b"") == 0


def test_queries_return_their_columns(spark, sf_dir):
    want = {
        "op1": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op2": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op3": "doc_id start n_tokens ids_crc32",
        "op4": "doc_id n_words n_hit n_items items_sha256 contaminated", "op5": "page_id url text n_chars", "op6": "doc_id held_out score predicted", "op7": "doc_id n_words n_base first_word last_word base_labels labels score",
        "op8": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op9": "doc_id n_shingles component_id", "op10": "doc_id n_assign n_access n_hex base_sha256 spans",
    }
    found = {k.split("_")[0]: q for k, q in registry.queries().items()}
    assert set(found) == set(want)
    for k, names in want.items():
        if k in ("op3", "op9"):
            continue  # their tests read all columns
        df = found[k](spark, sf_dir)
        assert set(names.split()) <= set(df.columns), k
        assert {t for c, t in df.dtypes if c.startswith("n_") or c in ("doc_id", "start", "length")} <= {"bigint"}, k
