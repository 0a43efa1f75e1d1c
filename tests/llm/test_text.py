"""Vectorised words and hashes, token ids by chunks, native spans and prefix sums, components."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from ledgerloom.llm import columns, native, tokens
from ledgerloom.llm.components import components
from pyspark.sql import functions as F

TEXT = st.lists(st.one_of(st.none(), st.text(alphabet="aZ0é \n\t\x0b\x85 　.'<|>", max_size=40)), max_size=8)


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_words_are_those_of_the_pattern(texts):
    for table, pattern in ((columns.NOT_SPACE, r"[^\x20\x09-\x0D]+"), (columns.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        w = columns.Words(pa.array(texts, pa.string()), table)
        got = [[w.data[a:b].tobytes().decode() for a, b in zip(w.starts[i:j], w.ends[i:j], strict=True)] for i, j in zip(w.first, w.first[1:], strict=False)]
        assert got == [re.findall(pattern, lower(t)) for t in texts]


@settings(max_examples=100, deadline=None)
@given(TEXT)
def test_same_words_have_same_hashes(texts):
    seen = {}
    for part in (texts, texts[::-1], ["pad pad", *texts]):
        w = columns.Words(pa.array(part, pa.string()), columns.NOT_SPACE)
        for a, b, h in zip(w.starts, w.ends, w.hashes(), strict=True):
            assert seen.setdefault(w.data[a:b].tobytes(), h) == h
    assert len(set(seen.values())) == len(seen)


def test_ngrams_stay_within_texts():
    w = columns.Words(pa.array(["a b c d", None, "a b", "b c d"]), columns.NOT_SPACE)
    grams, at = columns.ngrams(w.hashes(), w.first, 3)
    assert at.tolist() == [0, 1, 6] and grams[1] == grams[2] != grams[0]
    assert columns.ngram_key(w.hashes()[1:4]) == grams[1]


def test_slices_are_bounded_and_whole():
    batch = pa.record_batch([pa.array(["x" * n for n in (5, 50, 500, 1, 1, 1)])], names=["text"])
    parts = list(columns.text_slices(iter([batch]), limit=60))
    assert [p.num_rows for p in parts] == [2, 1, 3] and pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))


HARD = ["", None, " a  b\n\nc \n", "x y z　w q  r", "don't I'll  \t z", "<|endoftext|> a <|endoftext|>b <|startoftext|>c", "é è́ ê á,b", "  lead", "trail  ", "a\r\nb c", "1 2 33 444", "\x1c a\x1c b", "A\u0085 b \u0085c", "Σίσυφος ΟΔΟΣ.", "a≮b a<b a≠", "日本語 テキスト。 ok"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_of_chunks_are_those_of_texts(name):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    whole, ours = Tokenizer.from_file(public.path(name)), tokens.Encoder(public.path(name))
    rnd = random.Random(3)
    pieces = ["a", "Be", "é", " ", " ", "\n", "\t", ".", ",", "'s", "'", "12", " ", " ", "<|", "|>", "<|endoftext|>", "!!", "ß", "́"]
    texts = HARD + ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 40))) for _ in range(600)]
    ids, counts = ours.ids(pa.array(texts, pa.string()))
    at = np.concatenate([[0], np.cumsum(counts)])
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == whole.encode(t or "", add_special_tokens=False).ids, t


def test_chunks_met_again_stay(monkeypatch):
    """When the kept chunks get too many, those of several slices stay, and ids are the same as ever."""
    public = pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(tokens, "KEPT", 60)
    rnd, often = random.Random(5), [f"often{k}" for k in range(10)]
    small = tokens.Encoder(public.path("byte_bpe_50k.json"))
    for n in range(30):
        texts = pa.array([" ".join([*often, *(f"w{rnd.randrange(10**6)}" for _ in range(15))]) for _ in range(2)] + ["", None])
        ids, counts = small.ids(texts)
        want, sizes = tokens.Encoder(public.path("byte_bpe_50k.json")).ids(texts)
        assert ids.tolist() == want.tolist() and counts.tolist() == sizes.tolist()
        assert len(small.slots) <= 60 and list(small.slots.values()) == list(range(len(small.slots)))
        assert n < 2 or {" " + x for x in often[1:]} <= set(small.slots)


def test_forgetting_chunks_changes_nothing(monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    texts = pa.array([f"w{k} v{k % 7}" for k in range(50)])
    want = tokens.Encoder(public.path("byte_bpe_50k.json")).ids(texts)[0].tolist()
    monkeypatch.setattr(tokens, "KEPT", 20)
    small = tokens.Encoder(public.path("byte_bpe_50k.json"))
    for _ in range(3):
        assert small.ids(texts)[0].tolist() == want


def test_native_matches_and_prefix_sums(spark):
    rnd = random.Random(1)
    rows = [("",), (None,), ("é" * 3 + " 77 " * 1000,)] + [("".join(rnd.choice("é1 2a\x01\x02") for _ in range(rnd.randint(0, 1500))),) for _ in range(30)]
    df = spark.createDataFrame(rows, "text string")
    for r in df.select("text", native.matches(F.col("text"), "[0-9]+").alias("m")).collect():
        assert [tuple(x) for x in r.m] == [(m.start(), m.end(), m.group()) for m in re.finditer("[0-9]+", r.text or "")]
    numbers = spark.createDataFrame([([*range(n)],) for n in (0, 1, 255, 256, 257, 1000)], "v array<bigint>")
    for r in numbers.select("v", native.scan(F.col("v"), F.lit(0).cast("long"), lambda a, b: a + b, "bigint").alias("s")).collect():
        assert r.s == [sum(r.v[:k]) for k in range(len(r.v))]


def test_components(spark):
    rnd = random.Random(2)
    chain = [(k, k + 1) for k in range(60)]
    star = [(100, 100 + k) for k in range(1, 50)]
    mixed = [(rnd.randrange(200, 300), rnd.randrange(200, 300)) for _ in range(80)]
    edges = chain + star + mixed + mixed[:5]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        parent[hi] = lo
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
