"""TF-IDF search by number: the same as by rows of terms, and without a row per occurrence."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.operators import tfidf, tfidf_numbers as B


def documents(spark):
    rng = random.Random(6)
    vocabulary = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)] + ["ä_1"]
    texts = [" ".join(rng.choices(vocabulary, [1 / (j + 1) for j in range(37)], k=rng.randint(0, 40))) for _ in range(150)]
    texts += [texts[3]] * 25 + ["", None, "  ", "- x", "waa " * 30, "never asked words only"]
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "chunk_id STRING, content STRING").repartition(3)


def questions(spark):
    texts = ["waa wab wac", "waa", "wff ä_1 wfe", "unknown entirely", "", None, "wab wab wba wbb", *(f"w{a}{b} wa{b}" for a in "abcdef" for b in "abc")]
    return spark.createDataFrame(list(enumerate(texts)), "query_id INT, query STRING")


@pytest.mark.parametrize("max_terms,stop_words,k", [(5, (), 3), (40, ("waa",), 5), (100_000, (), 2)])
def test_search_by_number_equals_that_by_rows(spark, monkeypatch, max_terms, stop_words, k):
    for name, value in (("_PART", 700), ("_CELLS", 400), ("_QUERIES", 7)):
        monkeypatch.setattr(B, name, value)
    docs, asked = documents(spark), questions(spark)
    search = lambda: {(r.query_id, r["rank"]): (r.chunk_id, r.score) for r in tfidf.search(docs, asked, k, max_terms=max_terms, stop_words=stop_words).collect()}
    got = search()
    monkeypatch.setattr(B, "count_terms", lambda *a: None)
    want = search()
    assert {at: hit[0] for at, hit in got.items()} == {at: hit[0] for at, hit in want.items()} and len(got) > 20
    assert [got[at][1] for at in got] == pytest.approx([want[at][1] for at in got])


@pytest.mark.parametrize("part", [50, 4_000_000])
def test_no_frequent_pair_is_missed(spark, monkeypatch, part):
    monkeypatch.setattr(B, "_PART", part)
    rows, words, found = B.count_terms(documents(spark), "chunk_id", F.split(F.trim("content"), " +"), 12)
    got = {r.term: (r.df, r.total) for r in found.collect()}
    least = min(total for term, (_, total) in got.items() if " " not in term)
    df, total = {}, {}
    for r in documents(spark).where("content is not null").collect():
        ts = r.content.split()
        pairs = [f"{a} {b}" for a, b in zip(ts, ts[1:])]
        for p in pairs:
            total[p] = total.get(p, 0) + 1
        for p in set(pairs):
            df[p] = df.get(p, 0) + 1
    assert {t: n for t, n in got.items() if " " in t} == {p: (df[p], n) for p, n in total.items() if n >= least}
    assert any(" " in t for t in got) and sorted(words) == sorted(t for t in got if " " not in t)


def test_too_many_pairs_are_left_to_rows(spark, monkeypatch):
    monkeypatch.setattr(B, "MAX_PAIRS", 10)
    assert B.count_terms(documents(spark), "chunk_id", F.split(F.trim("content"), " +"), 100_000) is None


def test_packed_numbers_of_either_width():
    import pyarrow as pa

    for kind in ("<u2", "<u4"):
        kind = np.dtype(kind)
        piece = pa.RecordBatch.from_arrays([pa.array([np.array([1, 0, 2], kind).tobytes(), b"", np.array([65535], kind).tobytes()])], names=["_t"])
        number, row = B._unpacked(piece, kind)
        assert number.tolist() == [1, 0, 2, 65535] and row.tolist() == [0, 0, 0, 2]


def test_no_row_per_occurrence(spark):
    """Neither an occurrence nor a pair of a query and a document is a row: no term is exploded or joined."""
    from checks.search import CHECKS

    plan = CHECKS["ret_14_tfidf_search"][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan


def test_excerpts_make_rows_of_query_terms_only(spark, monkeypatch):
    from checks.search import CHECKS

    seen, counts = [], tfidf.term_counts
    monkeypatch.setattr(tfidf, "term_counts", lambda docs, id_col, *a: seen.append(id_col) or counts(docs, id_col, *a))
    assert CHECKS["ret_15_excerpt_context"][0](spark, "/root/testdata/sf0.001").count() > 0
    assert seen == ["query_id"]
