import html
import re

import pytest

from pyspark.sql import functions as F

from marginalia.llm import html_text
from marginalia.llm.common import table

SF = "/root/testdata/sf0.001"


def test_blocks():
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>if (a < b) document.write("<p>x</p>")</script></head>
    <body><nav><ul><li><a href="/a">Home</a><li><a href='/b'>Two</a></ul></nav><!-- <p>no</p> -->
    <div class="main-text" id=x1><h1>A &amp; B</h1><p>one<b>two</b> three<br>four <p>five &lt;tag&gt; 1 < 2</div><p hidden>gone</p>tail"""
    found = html_text.blocks(page)
    assert [b.text for b in found] == ["Home", "Two", "A & B", "onetwo three four", "five <tag> 1 < 2", "tail"]
    assert found[0].link == 1.0 and found[2].path[-4:] == ("#text", "#x", "#1", "h1") and "#main" in found[4].path
    assert html_text.blocks("") == [] and html_text.blocks("<p>open &am") [0].text == "open &am"
    assert [b.text for b in html_text.blocks("<script>never closed <p>x")] == []


def test_gradients():
    """Backpropagation through time against differences."""
    import numpy as np

    model = html_text.Labeller()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    pages = [html_text.encode(html_text.blocks(f"<div class=a><p>{t}</p><p>more of it</p></div>"), {}) for t in ("one two", "three")]
    pages[1] = tuple(x[:1] for x in pages[1])
    labels = [np.array([1.0, 0.0]), np.array([0.0])]

    def loss():
        x, mask = model.vectors(pages)
        s = html_text.sigmoid(model.raw(x, mask))
        y = np.array([[1.0, 0.0], [0.0, 0.0]])
        return float(-(mask * (y * np.log(s) + (1 - y) * np.log(1 - s))).sum() / mask.sum())

    before = {k: v.copy() for k, v in model.p.items()}
    moments = {}
    model.step(pages, labels, moments, 1, 0.0)
    for name in ("xf", "hb", "path", "out", "cb"):
        flat = np.argsort(-np.abs(moments[name][0]).ravel())[:3]
        for i in flat:
            model.p[name].ravel()[i] += 1e-3
            up = loss()
            model.p[name].ravel()[i] -= 2e-3
            down = loss()
            model.p[name] = before[name].copy()
            assert abs((up - down) / 2e-3 - moments[name][0].ravel()[i] * 10) < 2e-3


def test_pages_equal_a_plain_reading(spark):
    pages = table(spark, SF, "pages")
    rows = html_text.extract(pages, html_text.fit(pages)).collect()
    for r in rows:
        inner = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        plain = re.sub("<[a-z/][^>]*>", " ", re.sub("</?b>", "", inner))
        assert r.text == " ".join(html.unescape(plain).split())


def test_other_layouts(spark):
    """Layouts without any semantic element, from a model trained on the given pages."""
    import numpy as np

    pages = [r.html for r in table(spark, "/root/testdata/sf0.01", "pages").orderBy("page_id").limit(200).collect()]
    model, rng = html_text.train(pages[:150]), np.random.default_rng(99)
    right = total = 0
    for page in pages[150:]:
        found = html_text.blocks(page)
        again, truth = html_text.relayout(found, html_text.own_labels(found), rng)
        likely = model.label([html_text.encode(html_text.blocks(again), {})])[0]
        right += sum((likely >= 0.5) == np.array(truth))
        total += len(truth)
    assert right / total > 0.93


def test_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, "u"), (2, "", "u"), (3, "<html><body>", "u"), (4, "<p>" + "word " * 50_000, "u"), (4, "<p>" + "word " * 50_000, "u")],
                                  "page_id bigint, html string, text string")
    model = html_text.fit(pages)
    out = html_text.extract(pages, model)
    assert out.columns == ["page_id", "html", "text"] and out.filter(F.col("page_id") < 4).select("text").distinct().collect() == [("",)]
    assert len({r.text for r in out.filter("page_id = 4").collect()}) == 1
    assert html_text.extract(pages.filter(F.lit(False)), model).count() == 0


def test_training_pages_are_different_labelled_and_of_any_length(spark):
    """Many copies of one page, plain pages and one long page with an article."""
    copies = ["<article><p>the same page</p></article>"] * 300
    plain = [f"<div><p>plain {i}</p></div>" for i in range(300)]
    long = "<article>" + "<p>long words of a page</p>" * 3_000 + "</article>"
    others = [f"<main><p>page {i}</p></main>" for i in range(5)]
    pages = spark.createDataFrame([(x,) for x in [*copies, *plain, long, *others]], "html string")
    assert sorted(html_text.sample(pages, 200)) == sorted([copies[0], long, *others])
    assert len(html_text.sample(pages, 3)) == 3
    assert html_text.fit(pages).learnt == 7
    assert len(html_text.sample(pages, 200, max_bytes=100_000)) < 200


def test_pages_without_semantic_elements(spark):
    """Generated layouts teach what main text is; class names that were never seen do not cost the text."""
    given = table(spark, "/root/testdata/sf0.01", "pages").orderBy("page_id").limit(150).select("page_id", "html")
    bare = given.withColumn("html", F.regexp_replace(F.regexp_replace("html", "<(article|main)[^>]*>", '<div class="pagebody">'), "</(article|main)>", "</div>"))
    assert not html_text.sample(bare, 10)
    model = html_text.fit(bare, most=100)
    assert model.learnt > 50
    want = {r.page_id: r.text.split() for r in html_text.extract(given, html_text.fit(given, most=100)).collect()}
    got = {r.page_id: r.text.split() for r in html_text.extract(bare, model).collect()}
    shared = sum(len(set(want[i]) & set(got[i])) for i in want)
    assert shared / sum(len(set(w)) for w in want.values()) > 0.85 and shared / sum(len(set(w)) for w in got.values()) > 0.85


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    model = html_text.fit(pages)
    assert model.learnt == 0 and html_text.extract(pages, model).count() == 0
