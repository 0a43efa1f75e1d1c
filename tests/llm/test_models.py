"""Boosting, the quality classifier, and main text extraction."""

import html
import random
import re

import numpy as np
import pytest
from ledgerloom.llm import boosting, html_main, quality_model
from pyspark.sql import functions as F
from tests_llm import table


def data(n, seed):
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(n, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    return x, y


def test_trees_learn_an_interaction():
    x, y = data(4000, 1)
    trees = boosting.Trees(rounds=40, depth=3).fit(x, y)
    u, v = data(1000, 2)
    assert ((trees.margin(u) > 0) == (v > 0.5)).mean() > 0.97


def test_additive_model_needs_its_pair():
    x, y = data(4000, 1)
    u, v = data(1000, 2)
    with_pairs = boosting.Additive(coarse=16).fit(x, y).probability(u)
    without = boosting.Additive(pairs=0).fit(x, y).probability(u)
    assert ((with_pairs >= 0.5) == (v > 0.5)).mean() > 0.9 > ((without >= 0.5) == (v > 0.5)).mean()
    assert boosting.Additive().fit(x[:0], y[:0]).probability(u[:3]).tolist() == [0.5] * 3


def test_calibration():
    rnd = np.random.default_rng(1)
    m = rnd.normal(size=5000) * 3
    y = (rnd.random(5000) < boosting.sigmoid(0.7 * m - 1)).astype(float)
    c = boosting.Calibration().fit(m, y, 0.9)
    assert abs(c.a - 0.7) < 0.1 and abs(c.b + 1) < 0.2
    assert y[c.probability(m) >= c.threshold].mean() >= 0.9


def test_features_do_not_depend_on_slices(texts):
    import pyarrow as pa

    whole = quality_model.features(pa.array([t for _, t in texts], pa.string()))
    parts = np.concatenate([quality_model.features(pa.array([t], pa.string())) for _, t in texts])
    assert np.allclose(whole, parts) and np.isfinite(whole).all() and whole.shape[1] == len(quality_model.FEATURES)


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    try:
        docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    except Exception:  # noqa: BLE001
        pytest.skip("the driver's tables are not here")
    got = quality_model.predictions(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert len(got) > 80 and np.mean([r.predicted == r.quality for r in got]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_labels_of_held_out_rows_teach_nothing(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    wrong = labels.withColumn("quality", F.when(quality_model.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    score = lambda x: sorted((r.doc_id, r.score) for r in quality_model.predictions(docs, x).collect())
    assert score(labels) == score(wrong)


def test_quality_on_hard_rows(spark, hard, none):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(0, 100, 3)] + [(5, None, 0), (None, 1, 0), (6, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality_model.predictions(hard, labels).collect()
    assert len(got) == hard.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    import zlib

    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert quality_model.predictions(none, labels).count() == 0
    assert {r.score for r in quality_model.predictions(hard, labels.limit(0)).collect()} == {0.5}


def test_a_repeated_document_is_one_label(spark):
    """Features of a labelled doc_id that stands in many rows come to the driver once."""
    docs = spark.createDataFrame([(k, f"words of text number {k} " * (k % 9 + 1)) for k in range(60)] + [(3, "some other text")] * 500, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    once = docs.filter("text <> 'some other text'").unionAll(spark.createDataFrame([(3, "some other text")], docs.schema))
    x = np.array([[0.0]])
    assert quality_model.fit(docs, labels).probability(np.repeat(x, len(quality_model.FEATURES), 1)) == quality_model.fit(once, labels).probability(np.repeat(x, len(quality_model.FEATURES), 1))


# pages


def main_text(source):
    page = html_main.Page(source)
    return page.text(html_main.trees().margin(page.features()))


def test_made_pages_that_were_not_seen():
    rnd, exact = random.Random(77), 0
    for _ in range(150):
        source, main = html_main.made_page(rnd)
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in main]
        exact += main_text(source) == "\n".join(x for x in want if x)
    assert exact >= 140


ARTICLE = "<h1>A title of it</h1><p>First words of the text, which are plain.</p><p>More &amp; more <a href=x>of it</a>,\n with  white space.</p><ul><li>One point is made.<li>Another follows it.</ul>"
BLOCKS = "A title of it\nFirst words of the text, which are plain.\nMore & more of it, with white space.\nOne point is made.\nAnother follows it."


@pytest.mark.parametrize(
    "around",
    [
        "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav><article>{}</article><footer>&copy; 2024 Someone.</footer>",
        '<header><h2>Site name</h2><a href=/>home</a></header><main><article>{}</article></main><aside><h3>Related</h3><p>Other things to read here.</p></aside>',
        '<div class="cookie-banner"><p>We use cookies to make this better.</p><button>OK</button></div><div class="content">{}</div><div class="footer">All rights reserved, of course.</div>',
        '<article>{}<section id="comments"><h3>Comments</h3><div class="comment"><b>Jo</b><p>I liked what is written here.</p></div><div class="comment"><p>I did not like it at all.</p></div></section></article>',
        '<article>{}<div class="ad">Buy this thing now. It is cheap.</div></article><form><label>Search</label><input type=text><button>go</button></form>',
        "<article>{}</article><script>var x = '<p>not this</p>'</script><noscript><p>Please switch it on.</p></noscript><style>p{{}}</style>",
    ],
)
def test_pages(around):
    assert main_text(f"<!DOCTYPE html><html><head><title>T</title></head><body>{around.replace('{}', ARTICLE, 1)}</body></html>") == BLOCKS


@pytest.mark.parametrize("name", ["sidebar-layout", "header-content", "promo-text", "cookie-story", "ad-free-zone", "related-post-body"])
@pytest.mark.parametrize("wrap", ['<div class="{0}">{1}</div>', '<article class="{0}">{1}</article>', '<div id="{0}"><div class=x>{1}</div></div>'])
def test_containers_with_misleading_names(name, wrap):
    article = "<h1>A title of it</h1><p>First words of the text, which are plain.</p><p>More of it, with white space. And so on.</p><ul><li>One point is made.<li>Another follows it.</ul>"
    page = f"<html><head><title>t</title></head><body><nav><a href=/>Home</a> <a href=/n>News</a></nav>{wrap.format(name, article)}<footer>(c) 2024 Some company.</footer></body></html>"
    assert main_text(page).split("\n") == ["A title of it", "First words of the text, which are plain.", "More of it, with white space. And so on.", "One point is made.", "Another follows it."]


def test_nothing_is_kept_below_what_is_dropped():
    rnd, g = random.Random(5), np.random.default_rng(5)
    for _ in range(100):
        page = html_main.Page(html_main.made_page(rnd)[0])
        odds = g.normal(size=len(page.tag)) * 3
        kept = page.decode(odds)
        assert all(kept[page.parent[v]] or not kept[v] for v in range(1, len(kept)))


def test_decoding_is_optimal():
    g = np.random.default_rng(6)
    page = html_main.Page("<div><p>a</p><p>bb bb</p></div><div>x<p>c</p></div>")
    n = len(page.tag)
    for _ in range(50):
        odds = g.normal(size=n)
        weight = [1 + np.log1p(x) for x in page.own]
        value = lambda kept: sum((1 if k else -1) * o * w for k, o, w in zip(kept, odds, weight, strict=True))
        best = -1e9
        for mask in range(2 ** (n - 1)):
            kept = [True, *(bool(mask >> k & 1) for k in range(n - 1))]
            if all(kept[page.parent[v]] or not kept[v] for v in range(1, n)):
                best = max(best, value(kept))
        assert value(page.decode(odds)) == pytest.approx(best)


@pytest.mark.parametrize(
    ("source", "blocks"),
    [
        ("", []), ("<p>a<p>b &amp; c", ["a", "b & c"]), ("<div>x<br>y</div>tail", ["x y", "tail"]), ("<", ["<"]), ("a < b <c> d", ["a < b d"]), ("<ul><li>a<li>b</ul>", ["a", "b"]), ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]),
        ("<p>cut &am", ["cut &am"]), ("<script>x", []), ("<p>a</p><p", ["a"]), ("&#233;&#x41;&nbsp;z", ["éA z"]), ("<p><b>a<br><p>b", ["a", "b"]), ("<!-- <p>no</p> --><p>yes", ["yes"]), ("<P CLASS=x>a</P >b", ["a", "b"]), ("<p title='a>b'>c", ["c"]), ("</p>a</div>b", ["ab"]),
        ("<select><option>o</select><p>t<textarea>x</textarea>u", ["tu"]),
    ],
)
def test_tree(source, blocks):
    assert [t for _, t in html_main.Page(source).blocks] == blocks


@pytest.mark.parametrize(("source", "blocks"), [
    ("<html><head><title>x</title><meta charset=utf-8><body><p>a</p><p>b", ["a", "b"]),
    ("<head><title>x</title><link rel=a><p>a</p><div>b</div>", ["a", "b"]),
    ("<head><style>x</style>a<p>b", ["a", "b"]),
    ("<head><noscript><style>x</style><body><p>a", ["a"]),
    ("<head><noscript><p>x</p></noscript><title>y</title></head><body><p>a", ["a"]),
    ("<p>a <head> b</p><p>c", ["a b", "c"]),
    ("<div>a <svg><path d='x'><text>x</text><p>b</p> c</div>", ["a", "b", "c"]),
    ("<div>a <svg viewBox='0 0 1 1'/> b <svg/>c</div>", ["a b c"]),
    ("<div>a <svg><foreignObject><div>x</div></foreignObject><text>y</text></svg> b</div>", ["a", "b"]),
    ("<p>so <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>1</mn></mrow><annotation encoding='tex'>y</annotation></semantics></math> holds</p>", ["so x=1 holds"]),
    ("<p>so <math><mi>x</mi><semantics><annotation>y<p>b", ["so x", "b"]),
])
def test_head_svg_and_math_that_stay_open(source, blocks):
    assert [t for _, t in html_main.Page(source).blocks] == blocks


def test_time_is_linear():
    import time

    for source in ("<p " * 50_000, "<div>" * 20_000 + "x", "<p>" + "a&amp;" * 50_000, "<a href='" * 30_000, "<!--" * 50_000, "<p>a</b>" * 20_000, "<script>" * 20_000, "<div>" * 20_000 + "</p>" * 20_000, "<b>" * 20_000 + "</i>" * 20_000, "<table><tr><td>" * 8_000):
        began = time.time()
        main_text(source)
        assert time.time() - began < 20, source[:8]


def test_extraction(spark):
    rows = [(1, "u", f"<article>{ARTICLE}</article>", "x"), (2, None, None, "y"), (3, "u", "", "z"), (1, "u", f"<article>{ARTICLE}</article>", "x"), (None, "v", "<article><h1>Words</h1><p>And some more of them, too.", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in html_main.summary(pages).collect())
    assert got == sorted([("1", BLOCKS, len(BLOCKS)), ("1", BLOCKS, len(BLOCKS)), ("2", "", 0), ("3", "", 0), ("None", "Words\nAnd some more of them, too.", 33)])
    assert html_main.summary(pages.limit(0)).count() == 0
