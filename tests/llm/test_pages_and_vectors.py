"""Main text, URL verdicts and top-k search."""

import itertools
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.llm import html_text, topk, url_filter

PAGE = """<html><head><title>T</title><script>var t="</p>";</script></head><body><header>Site</header><div id="cookie-notice">We use cookies</div>
<main><article><h1>Head &amp; Tail</h1><p>One <b>two</b>
 three<p>Four &lt;x&gt; 5 < 6 <a href=x>link</a> in text that goes on.<div class="share">share</div><form><p>mail me</p></form>
<section id="comments"><p>A reader said a thing that is long enough to look like text.</p></section></article></main><footer>foot</footer></body>"""


def test_main_text():
    tree = html_text.train()
    assert html_text.main_text(PAGE, tree) == "Head & Tail\n\nOne two three\n\nFour <x> 5 < 6 link in text that goes on."
    assert html_text.main_text(None, tree) == html_text.main_text("<p", tree) == ""
    assert all(html_text.is_content(tree, row[:-1]) == row[-1] for row in html_text.LABELLED_BLOCKS)


STORY = "<p>This is a story of some length that has no links at all and goes on for a while.</p>"


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><meta charset=utf-8><body><article>{}</article></body></html>", "<head><title>T</title><link rel=x><article>{}</article>", "<head><noscript><p>no</p></noscript><article>{}</article>", "<html><head><title>T<body><article>{}</article>",
        "<head><title>T</head><body><article>{}</article>", "<head><script>'</head><p>no</p>'</script><meta name=a></head><article>{}</article>", "<body><button>Go<article>{}</article>", "<body><div><select><option>A<option>B</div><article>{}</article>",
        "<body><noscript><img src=x><article>{}</article></body>", "<body><button>Go<article>{}</article><button>Stop</button></body>", "<body><svg><path d=x><article>{}</article><svg><g></g></svg></body>",
        "<body><article><button><div>no</div></button><svg><svg></svg><text>no</text></svg><video><p>no</p></video>{}<textarea>no</textarea></article></body>", "<body><article>{}</article><script>no<p>no</p>", "<body><article>{}</article><!-- no <p>no</p>",
    ],
)
def test_silent_elements_without_end_tag_take_no_text(page):
    tree = html_text.train()
    assert html_text.main_text(page.format(STORY), tree) == STORY[3:-4]


@pytest.mark.parametrize("bad", ["<a ", "<", '<a "', "<a '\">", "<svg><p>", "<div>", "</b>", "<script ", "<button>", "<!--", "<i><li></i>", "&amp;"])
def test_long_broken_pages_take_a_few_passes(bad):
    tree = html_text.train()
    began = time.process_time()
    html_text.main_text(bad * (300_000 // len(bad)), tree)
    assert time.process_time() - began < 10
    assert html_text.main_text(f"<article>{STORY}</article>" + bad * 3, tree).startswith(STORY[3:-4])


def test_text_ends_a_head():
    assert [b[0] for b in html_text.blocks("<head><meta name=a>One two <b>three</b><p>four")] == ["One two three", "four"]
    assert [b[0] for b in html_text.blocks("<head>stray <meta name=a></head>One")] == ["One"]


def _words(n):
    return " ".join(["word"] * n)


@pytest.mark.parametrize(
    "page,sizes",
    [
        ("".join(f"<div>{_words(k)}</div>" for k in (60, 30, 35, 20)), [60, 30, 35, 20]),
        ("<h1>Head</h1><p>One two three four.<p>Five six seven.", [1, 4, 3]),
        (f"<article><h2 id='social-impact'>Impact</h2><p>{_words(30)}<h2 id=search>Search</h2><p>{_words(20)} <math><mi>x</mi></math> is</article>", [1, 30, 1, 22]),
        (f"<ul><li><a href=x>Home</a><li>News<li><a href=x>About us</a></ul><div>{_words(40)}</div><div>{_words(12)}</div><div><a href=x>a b</a></div><div>Top ten</div><div><a href=x>c</a></div>", [40, 12]),
    ],
)
def test_blocks_stay_or_go_by_their_neighbours(page, sizes):
    assert [len(b.split()) for b in html_text.main_text(page, html_text.train()).split("\n\n")] == sizes


def test_the_tree_asks_for_the_links_of_neighbours():
    def asked(tree):
        return {html_text.FEATURES[tree[0]]} | asked(tree[2]) | asked(tree[3]) if isinstance(tree, tuple) else set()

    tree = html_text.train()
    assert {"links", "links_after", "words_before", "marked", "in_article"} <= asked(tree)
    for words, links, before, after, beside in itertools.product((1, 20, 200), (0, 0.3), (0, 20), (0, 60), (0, 1)):
        row = (words, links, before, beside, after, beside)
        assert html_text.is_content(tree, (*row, 0, 1)) and not html_text.is_content(tree, (*row, 1, 0))


def test_extract_keeps_columns(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "old"), (2, None, None, "old")], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    assert got[1].n_chars == len(got[1].text) and got[2].text == "" and got[1].url == "u"
    assert html_text.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "url,host,path,rule",
    [
        ("https://a.Example.ORG/es/1?x", "a.example.org", "/es/1", "example.org/es/"), ("http://example.org/en/12#t", "example.org", "/en/12", "example.org/en/1"), ("http://x.org/", "x.org", "/", "org/"), ("http://b.com/fr/1", "b.com", "/fr/1", "com/fr/"),
        ("http://b.com/en", "b.com", "/en", None), ("http://forg/", "forg", "/", None), ("no scheme", "", "", None), (None, "", "", None), ("http://x.org", "x.org", "", None), ("a://b://c/d", "b:", "//c/d", None),
    ],
)
def test_rules(spark, url, host, path, rule):
    rows = spark.createDataFrame([(1, url)], "page_id long, url string")

    class Nothing:
        def blocked(self, urls, url):
            return urls.selectExpr("*", "false as blocked")

    got = url_filter.judge(rows, url_filter.rules_table(spark), Nothing()).first()
    assert (got.host, got.path, got.rule) == (host, path, rule)
    assert got.verdict == (dict(url_filter.RULES)[rule] if rule else "allow")


@pytest.fixture(scope="module")
def url_model(spark):
    """Trained without the names whose hash is divisible by three."""
    labelled = url_filter.labelled_urls(spark).withColumn("held_out", F.pmod(F.xxhash64("name"), F.lit(3)) == 0)
    return url_filter.UrlModel(labelled.filter("not held_out")), labelled.filter("held_out")


def test_trees_judge_names_they_have_not_seen(url_model):
    model, held_out = url_model
    got = model.blocked(held_out).collect()
    assert len(got) > 500 and np.mean([r.blocked == (r.label == 1) for r in got]) > 0.9
    weight = model.trees.featureImportances.toArray()
    assert weight.max() < 0.7 and (weight > 0.01).sum() >= 5


def test_urls_of_any_kind_are_judged(spark, url_model):
    long = "http://a.org/" + "x/" * 50_000
    rows = spark.createDataFrame([(1, long, "h"), (2, None, "h"), (3, "", "h"), (3, "", "h"), (4, "http://b.com/fr/1", None)], "depth long, url string, host string")
    out = url_filter.judge(rows, url_filter.rules_table(spark), url_model[0])
    assert out.columns == ["depth", "url", "host", "path", "rule", "verdict"]
    got = out.collect()
    assert sorted((r.depth, r.host, r.rule) for r in got if r.rule) == [(1, "a.org", "org/"), (4, "b.com", "com/fr/")]
    assert len(got) == 5 and len({r.verdict for r in got if not r.host}) == 1
    assert url_filter.judge(rows.limit(0), url_filter.rules_table(spark), url_model[0]).count() == 0
    with pytest.raises(ValueError):
        url_model[0].blocked(rows.withColumnRenamed("depth", "_lex_depth"))


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e13])
def test_top_k_is_exact(scale):
    r = np.random.default_rng(2)
    c = np.floor(r.normal(size=(300, 16)) * 100 * scale).astype(np.int64)
    c[7] = c[3]
    ids, q = np.arange(300) * 2, c[[0, 3, 7, 9]]
    row, cand, score = topk.top_of_block(ids[[0, 3, 7, 9]], q, ids, c, 5)
    for k, own in enumerate((0, 3, 7, 9)):
        exact = [(-sum(int(a) * int(b) for a, b in zip(q[k], c[j])), int(ids[j])) for j in range(300) if j != own]
        assert [(-int(s), int(ids[j])) for j, s in zip(cand[row == k], score[row == k])] == sorted(exact)[:5]


def test_bad_vectors_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.5]), (1, [0.5, 0.5]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, []), (6, [float("inf"), 0.0]), (7, [1.0])]
    v = topk.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(v.filter("vec_id % 50 = 0"), v).collect())
    assert got == [(0, 1, 50, 65536), (0, 2, 1, 32768), (50, 1, 0, 65536), (50, 2, 1, 49152)]
    assert topk.top_k(v.limit(0), v).count() == 0


def test_large_components_and_ties_across_blocks(spark):
    r = random.Random(5)
    rows = [(k, [float(r.choice([0, 1, -1, 1e13, -1e13, 1e18, 3e300, 0.37])) for _ in range(3)], "x", 1) for k in range(120)]
    rows += [(k, [1.0, 2.0, float(k % 3)], "x", 1) for k in range(120, 160)]  # ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string, rank int")
    low, high = -(2**63), 2**63 - 1
    whole = {i: [math.floor(256 * x) for x in e] for i, e, *_ in rows}
    score = lambda a, b: max(low, min(high, sum(x * y for x, y in zip(whole[a], whole[b], strict=True))))
    expected = []
    for q in range(0, 160, 50):
        best = sorted((-score(q, c), c) for c in whole if c != q)[:5]
        expected += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    vectors = topk.scaled(df)
    got = topk.top_k(vectors.filter("vec_id % 50 = 0"), vectors, block=23, query_block=3)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()) == expected
