"""Main-text extraction: exact inference, markup reader, held-out pages."""

import html
import itertools
import math
import re

import pyarrow.parquet as pq
import pytest

from sessionloom.llm.dom import parse
from sessionloom.llm.extraction import Model, extract, features, kind, main_text, train

PAGES = "/root/testdata/sf0.001/pages.parquet"


def test_marginals_equal_the_sum_over_all_labelings():
    model = Model()
    model.weights |= {"tag:div": 0.7, "tag:h1": -0.4, "own:4": 0.9}
    page = parse("<div>long words here, yes<p>some</p><h1>head</h1></div><nav><p>x y</p></nav><p>tail")
    nodes = page.nodes
    own = [sum(model.weights.get(f, 0.0) for f in found) for found in features(page)]
    total, mass = 0.0, [0.0] * len(nodes)
    for labels in itertools.product((0, 1), repeat=len(nodes)):
        w = math.exp(sum(o for o, y in zip(own, labels) if y))
        for i, x in enumerate(nodes[1:], 1):
            p = model.pairs.get(kind(x, False), model.pairs[""])[labels[x.parent]]
            w *= p if labels[i] else 1 - p
        total += w
        for i, y in enumerate(labels):
            mass[i] += w * y
    assert model.marginals(page) == pytest.approx([m / total for m in mass])


def test_reader_takes_broken_markup():
    page = parse("<ul><li>one<li>two <b>bold<script>var x='</li>';</script></ul>tail &amp; more<p>a<p>b&nbsp;c<br>d<table><tr><td>1<td>2</table>")
    assert [t for _, t in page.blocks] == ["one", "two bold", "tail & more", "a", "b c d", "1", "2"]
    assert parse(None).blocks == parse("").blocks == []
    assert [t for _, t in parse("a < b <x" + "<" * 50).blocks][0].startswith("a < b")


def test_reader_keeps_formulas_and_what_follows_unclosed_elements():
    page = parse("<p>where <math><mi>E</mi></math> is energy</p><noscript><p>plain text</p></noscript><template><p>held</p></template>")
    assert [t for _, t in page.blocks] == ["where E is energy", "plain text", "held"]
    for tag in ("svg", "math", "noscript", "template", "title", "textarea", "iframe"):
        assert [t for _, t in parse(f"<p>one</p><{tag}><p>two</p>").blocks] == ["one", "two"]
    assert [t for _, t in parse("<p>one</p><script>var x = 1; <p>two</p>").blocks] == ["one"]


def test_all_names_of_an_element_are_seen():
    page = parse(f"<div class='{' '.join('n' + c for c in 'abcdefghijk')}'>x</div>")
    assert "name:nk" in features(page)[1]


def article(h):
    m = re.search(r"<article>(.*?)(</article>|\Z)", h, re.S)
    parts = re.split(r"</?(?:p|h1)[^>]*>", m[1])
    blocks = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in parts]
    return "\n\n".join(b for b in blocks if b)


def test_pages_of_the_table(spark):
    df = spark.read.parquet(PAGES)
    got = {r["page_id"]: r for r in extract(df, train(df)).collect()}
    for r in pq.read_table(PAGES).to_pylist():
        assert got[r["page_id"]]["text"] == article(r["html"])
        assert got[r["page_id"]]["n_chars"] == len(article(r["html"]))


def test_furniture_inside_and_without_article(spark):
    model = train(spark.read.parquet(PAGES))
    text = main_text(model, """<body><header><h1>My site</h1></header><article><header><h1>The story</h1></header>
      <p>First para of the story, which is long enough to read.</p><aside>Related links here</aside>
      <form><label>Mail</label></form><section class="comments"><h2>Comments</h2><p>I think so. Great, very good.</p></section>
      <ul><li>An item</li></ul><p>Last para &amp; end.</p></article><div class="cookie-notice">We use cookies</div></body>""")
    assert text.split("\n\n") == ["The story", "First para of the story, which is long enough to read.", "An item", "Last para & end."]


def test_awkward_rows(spark):
    rows = [(1, None, None, 1), (1, "u", "", 1), (2, "u", "<p>" + "word " * 50000, 1), (None, "u", "<script>x", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted(((r["page_id"], r["n_chars"]) for r in extract(df, train(df)).collect()), key=str)
    assert [g[1] for g in got if g[0] == 1] == [0, 0] and (None, 0) in got
    empty = df.limit(0)
    assert extract(empty, train(empty)).count() == 0
