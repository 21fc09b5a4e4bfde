import random
import re

import pytest
from pyspark.sql import functions as F

from marginalia.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text, items, window):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, found = set(), set()
    for item, body in items:
        its = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), body or ""))
        size = min(window, len(its))
        grams = {tuple(its[i : i + size]) for i in range(len(its) - size + 1)} if size else set()
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in grams:
                hit.update(range(i, i + size))
                found.add(item)
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("most", [2_000_000, 40])
def test_equals_brute_force(spark, most):
    rng = random.Random(3)
    word = lambda: rng.choice("a b c dé E 1".split())
    items = [(i, " ".join(word() for _ in range(rng.randrange(0, 12)))) for i in range(12)] + [(3, "a b c"), (50, None)]
    texts = [(i, " ,".join(word() for _ in range(rng.randrange(0, 60)))) for i in range(60)] + [(60, None), (61, "")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.doc_id: (r.n_words, r.hit, r["items"]) for r in d.mark_contamination(docs, bench, 5, max_words=most).withColumn("hit", d.hits()).collect()}
    for i, text in texts:
        n, hit, found = brute(text, [(str(a), b) for a, b in items], 5)
        assert got[i] == (n, hit, found)


def test_spans_are_cut_and_clean_texts_stay(spark, odd):
    bench = spark.createDataFrame([("x", "One two, three four"), (None, "five six seven eight")], "item_id string, text string")
    docs = spark.createDataFrame([
        (1, "Before ONE two THREE four, after it all comes more."), (2, "one two three four"), (3, "clean  text\n stays"), (4, None),
        (5, "a b c d one two five six seven eight three four e f g h i j k")], "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in d.remove_contamination(docs, bench, 4).collect()}
    assert got[1] == "Before , after it all comes more." and 2 not in got and got[3] == "clean  text\n stays" and got[4] is None
    assert brute(got[5], [("x", "One two, three four")], 4)[1] == 0
    marked = d.mark_contamination(odd, bench, 4)
    assert marked.count() == odd.count() and marked.columns.count("spans") == 1
    none = bench.filter(F.lit(False))
    assert d.mark_contamination(docs, none, 4).filter(F.size("items") > 0).count() == 0
    assert d.remove_contamination(docs, none, 4).count() == 5 and d.mark_contamination(docs.filter(F.lit(False)), bench).count() == 0
