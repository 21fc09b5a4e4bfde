"""Counts of words, pairs and triples against a plain loop."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marginalia.operators import neighbours as N
from marginalia.operators import phrases


@pytest.mark.parametrize("window,least,piece", [(3, 3, 4 << 20), (2, 2, 200), (5, 3, 50), (3, 1, 4 << 20)])
def test_neighbour_counts_are_those_of_a_loop(spark, monkeypatch, window, least, piece):
    monkeypatch.setattr(phrases, "_PIECE", piece)  # the helpers are pickled by reference; local workers fork with it
    rng = random.Random(5)
    texts = [(rng.choice("xy") if i % 9 else None, " ".join(rng.choice("abcdefghij") * rng.randint(1, 2) for _ in range(rng.randint(0, 30)))) for i in range(300)]
    texts += [("x", None), ("y", ""), ("x", "one"), ("y", "one two")]
    want: Counter = Counter()
    for tenant, text in texts:
        ws = (text or "").split()
        for i, w in enumerate(ws):
            want[tenant, w, None, None, "n"] += 1
            for gap in range(1, max(window, 3)):
                if i + gap < len(ws):
                    pair = tenant, w, ws[i + gap], None
                    want[*pair, "all"] += 1
                    want[*pair, "n"] += gap < window
                    want[*pair, "near"] += gap == 1
                    want[*pair, "far"] += gap == 2
            if i + 2 < len(ws):
                want[tenant, w, ws[i + 1], ws[i + 2], "n"] += 1
    docs = spark.createDataFrame(texts, "t STRING, text STRING").repartition(3)
    words = F.filter(F.split("text", " "), lambda w: w != "")
    rows = N.neighbour_counts(docs, words, ["t"], window, least).collect()
    assert len({(r.t, r.a, r.b, r.c) for r in rows}) == len(rows)
    got = {(r.t, r.a, r.b, r.c): r for r in rows}
    for (*key, kind), n in want.items():
        key = tuple(key)
        if key[3] is not None and n >= least or key[1] is not None and key[2] is None:
            assert got[key].n == n, key
        elif key[3] is None and kind != "all" and want[*key, "all"] >= least:
            assert got[key][kind] == n, key
    for key, r in got.items():  # and nothing that does not occur
        assert want[*key, "n"] == r.n and r.n + r.near + r.far > 0


def test_no_occurrence_becomes_a_row(spark):
    """Rare pairs stay in their tasks: what is counted behind the shuffle is the words and the repeated pairs."""
    docs = spark.createDataFrame([("x", " ".join(f"w{i * 50 + j}" for j in range(50))) for i in range(40)] * 1 + [("x", "again and again and again and")], "t STRING, text STRING")
    rows = N.neighbour_counts(docs, F.split("text", " "), ["t"], 3, 3)
    assert rows.where("b IS NOT NULL").count() < 10
    assert rows.where("b IS NULL").count() == 2002


def test_without_scope_and_without_words(spark):
    docs = spark.createDataFrame([("",), (None,)], "text STRING")
    assert N.neighbour_counts(docs, F.filter(F.split("text", " "), lambda w: w != ""), [], 3, 3).count() == 0
    docs = spark.createDataFrame([("a b a b a b",)], "text STRING")
    got = {(r.a, r.b, r.c): (r.n, r.near, r.far) for r in N.neighbour_counts(docs, F.split("text", " "), [], 3, 3).collect()}
    assert got[("a", "b", None)] == (3, 3, 0) and got[("a", None, None)][0] == 3
