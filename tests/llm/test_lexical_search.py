import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import lexical_search
from marginalia.llm.lexical_search import rank_documents
from marginalia.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    """[(item, rank, id, score)] of plain lists (id, text)."""
    counted = [(i, terms(t)) for i, t in docs]
    counted = [(i, w) for i, w in counted if w]
    n, total = len(counted), sum(len(w) for _, w in counted)
    df = {}
    for _, w in counted:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for doc, w in counted:
            m = 50 + 50 * len(w) * n // total
            score = 0
            for t in set(terms(text)):
                if tf := w.count(t):
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf // (1000 * tf + 20 * m))
            if score > 0:
                scored.append((-score, doc is None, doc if doc is not None else 0))
        out += [(item, r + 1, None if x[1] else x[2], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return out


def text(rng, size):
    return " ".join(f"w{min(int(rng.paretovariate(0.7)), 60)}" for _ in range(size))


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed, monkeypatch):
    """Small segments, so that the best of a task travel on; many copies, so that equal scores meet the limit."""
    monkeypatch.setattr(lexical_search, "_SEGMENT_DOCS", 40)
    monkeypatch.setattr(lexical_search, "_CELLS", 50)
    rng = random.Random(seed)
    docs = [(rng.randrange(10**6), text(rng, rng.choice([1, 3, 20, 80]))) for _ in range(250)]
    docs += [(rng.randrange(10**6), "w1 w7 w9") for _ in range(60)] + [docs[0], docs[0]]
    items = [(i, text(rng, rng.choice([1, 2, 10, 50]))) for i in range(8)] + [(90, "w1 w7 w9"), (91, "nowhere to be found")]
    rng.shuffle(docs)
    got = rank_documents(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), 12, max_terms=60)
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute(docs, items, 12))


def test_few_splits_are_made(spark, docs, monkeypatch):
    """Most documents are never scored: bounds leave them out."""
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    index = lexical_search.words
    number = {}
    posts, sizes = [], []
    for _, t in rows * 5:
        found = index((t or "").encode())
        counts = {}
        for w in found:
            at = number.setdefault(w, len(number))
            counts[at] = counts.get(at, 0) + 1
        posts.append((np.array(list(counts), np.int64), np.array(list(counts.values()), np.int64)))
        sizes.append(len(found))
    df = np.bincount(np.concatenate([p[0] for p in posts]), minlength=len(number))
    statistics = lexical_search.Statistics(len(posts), sum(sizes), np.array([lexical_search._weight(len(posts), int(d)) for d in df]))
    segment = lexical_search.Segment(list(range(len(posts))), sizes, posts, statistics)
    looked = []
    plain = lexical_search.Segment.bounds
    monkeypatch.setattr(lexical_search.Segment, "bounds", lambda self, a, b: looked.append(len(a)) or plain(self, a, b))
    rare = np.sort(np.argsort(df, kind="stable")[[5, 50]])
    segment.search(np.array(rare), 3, [])
    assert sum(looked) < len(posts) / 5


def test_range_maxima_equal_plain_maxima():
    random_ = np.random.default_rng(0)
    posts = [(np.sort(random_.choice(6, 4, replace=False)).astype(np.int64), random_.integers(1, 9, 4)) for _ in range(50)]
    statistics = lexical_search.Statistics(50, 1000, np.arange(6) * 100 + 1)
    segment = lexical_search.Segment(list(range(50)), [20] * 50, posts, statistics)
    for term in range(6):
        for a in range(0, 50, 3):
            for b in range(a, 51, 4):
                low, high = (segment.place(np.array([term]), np.array([x])) for x in (a, b))
                total, _ = segment.bounds(low, high)
                inside = segment.score[(segment.key >= term * 50 + a) & (segment.key < term * 50 + b)]
                assert total[0] == inside.max(initial=0)


def test_odd_rows(spark, odd):
    items = [(1, "alpha ZETA line"), (1, "w5x5 w6x6"), (2, None), (3, " .,!"), (None, "text without"), (4, "ÄÖ 中文 1234 😀"), (5, "ä")]
    asked = spark.createDataFrame([(*i, 0, "s") for i in items], "item_id int, text string, doc_id int, score string")
    want = brute([(r.doc_id, r.text) for r in odd.collect()], items, 50)
    got = [tuple(r) for r in rank_documents(odd, asked).collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key) and len(got) > 5
    for docs, queries in ((odd.filter(F.lit(False)), asked), (odd, asked.filter(F.lit(False)))):
        assert rank_documents(docs, queries).count() == 0


def test_query_types(spark):
    out = QUERIES["op12_lexical_search"](spark, SF)
    assert out.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
