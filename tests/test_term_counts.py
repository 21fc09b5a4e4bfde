"""Keywords counted by number: the same as by rows of terms, and without a row per occurrence."""

import random

import pytest

from marginalia.operators import linguistics as L
from marginalia.operators import term_counts


@pytest.mark.parametrize("max_terms", [5, 30, 100_000])
def test_keywords_by_number_equal_those_by_rows(spark, monkeypatch, max_terms):
    rng = random.Random(4)
    vocabulary = [f"w{chr(97 + i)}" for i in range(12)]
    rows = [(i, f"t{i % 2}", " ".join(rng.choices(vocabulary, [1 / (j + 1) for j in range(12)], k=rng.randint(0, 40)))) for i in range(80)]
    rows += [(100, "t2", "only one here"), (101, "t1", None), (102, "t1", "  "), (103, "t1", "1 2 --")]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, persona_id STRING, content STRING").repartition(3)
    got = L.keywords(docs, max_terms=max_terms, max_df=0.9).collect()
    monkeypatch.setattr(term_counts, "vocabulary", lambda *a: None)
    want = L.keywords(docs, max_terms=max_terms, max_df=0.9).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and {r.persona_id for r in got} == {"t0", "t1"}


def test_only_ngrams_of_frequent_words_are_counted(spark, monkeypatch):
    text = " ".join(f"often also rare{chr(97 + i)}" for i in range(20))
    docs = spark.createDataFrame([(i, "t", text) for i in range(3)], "doc_id BIGINT, persona_id STRING, content STRING")
    seen, counts = [], term_counts.gram_counts
    monkeypatch.setattr(term_counts, "gram_counts", lambda *a: seen.append(counts(*a)) or seen[-1])
    L.keywords(docs, max_terms=2, max_df=1.0).collect()
    assert sorted(r.term for r in seen[1].collect()) == ["often also"]
