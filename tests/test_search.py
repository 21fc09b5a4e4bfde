"""Search and fusion against brute force, with hot keys and with the paths for large query tables."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marginalia.operators import keyword_search as K, models as M, ranking as R, rerank as RR, vector_search as V
from marginalia.plans import retrieval as P

TEXTS = [
    "the cat sat on the mat", "the dog chased the cat", "dogs and cats are pets", "machine learning with spark", "spark runs the query plan",
    "the the the", "", "   ",
]


@pytest.fixture()
def corpus(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id BIGINT, content STRING")


@pytest.fixture()
def queries(spark):
    return spark.createDataFrame([(0, "cat the the"), (1, "spark plan"), (2, "nothing here"), (3, "")], "query_id BIGINT, query STRING")


def brute_bm25(query):
    docs = [re.findall(r"\w{2,}", t.lower()) for t in TEXTS if t.strip()]
    avg = sum(map(len, docs)) / len(docs)
    df = Counter(w for d in docs for w in set(d))
    out = {}
    for i, d in enumerate(docs):
        tf = Counter(d)
        s = sum(
            math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] / (tf[w] + 1.5 * (0.25 + 0.75 * len(d) / avg))
            for w in re.findall(r"\w{2,}", query.lower()) if w in df
        )
        if s > 0:
            out[i] = round(s, 6)
    return out


@pytest.mark.parametrize("small", [True, False])
def test_bm25_equals_brute_force_on_both_join_paths(spark, corpus, queries, small, monkeypatch):
    if not small:
        monkeypatch.setattr(K, "broadcast_if_small", lambda df, *a: df)
    got = K.bm25_search(corpus, queries, 10).collect()
    for q in queries.collect():
        mine = {r.doc_id: r.score for r in got if r.query_id == q.query_id}
        assert mine == pytest.approx(brute_bm25(q.query), abs=1e-6)


@pytest.mark.parametrize("scope", [[], ["persona_id"]])
def test_one_off_search_shuffles_no_pairs(spark, scope, monkeypatch):
    """Every document shares a word with every query: the rows are those of an index, yet pairs of both are never gathered."""
    words = ["the", "and", "cat", "dog", "spark"]
    docs = spark.createDataFrame([(f"d{i}", f"t{i % 3}", " ".join(["the"] + [words[(i * j) % 5] for j in range(i % 7)])) for i in range(200)],
                                 "doc_id STRING, persona_id STRING, content STRING").repartition(3)
    queries = spark.createDataFrame([(1, "t0", "the cat the"), (2, "t1", "and the"), (3, "t5", "spark the"), (4, "t2", "no such")],
                                    "query_id INT, persona_id STRING, query STRING")
    want = K.search(K.build_index(docs, scope=scope), queries, 5).collect()
    monkeypatch.setattr(K, "_CELLS", 50)  # several pieces of a batch
    got = K.bm25_search(docs, queries, 5, scope=scope)
    assert len(want) >= 10 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want))
    assert "Aggregate(keys=[query_id" not in got._jdf.queryExecution().executedPlan().toString()


def test_one_off_search_of_nothing(spark, corpus, queries):
    assert K.bm25_search(corpus, queries.limit(0), 5).count() == 0
    assert K.bm25_search(corpus.limit(0), queries, 5).count() == 0
    blank = corpus.withColumn("content", F.lit(None).cast("string"))
    assert K.bm25_search(blank, queries, 5).count() == 0


def test_search_of_an_index_makes_no_row_per_query_and_posting(spark, corpus, queries, tmp_path):
    K.build_index(corpus).write(str(tmp_path / "ix"))
    got = K.search(K.KeywordIndex.read(spark, str(tmp_path / "ix")), queries, 10)
    for q in queries.collect():
        assert {r.doc_id: r.score for r in got.where(F.col("query_id") == q.query_id).collect()} == pytest.approx(brute_bm25(q.query), abs=1e-6)
    assert "Aggregate(keys=[query_id" not in got._jdf.queryExecution().executedPlan().toString()


def test_search_adds_up_an_id_that_merged_indexes_hold_twice(spark, queries, monkeypatch):
    docs = spark.createDataFrame([(1, "the cat sat"), (2, "a dog and a cat"), (3, "nothing here")], "doc_id long, content string")
    more = spark.createDataFrame([(1, "cat and dog and dog again"), (4, "spark spark")], "doc_id long, content string")
    asked = spark.createDataFrame([(1, "cat dog"), (2, "spark again")], "query_id long, query string")
    index = K.add_documents(K.build_index(docs), K.build_index(more))
    got = sorted(map(tuple, K.search(index, asked, 5).collect()))
    monkeypatch.setattr(K, "broadcast_if_small", lambda df, *a: df)
    assert got and got == sorted(map(tuple, K.search(index, asked, 5).collect()))


@pytest.fixture(scope="module")
def frequent_terms(spark, tmp_path_factory):
    """Documents that nearly all hold "the" and "and", beside words of falling frequency and many equal texts; stored, by tenant."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(300)]
    chance = 1 / np.arange(1, 301)
    rows = []
    for i in range(3000):
        own = rng.choice(words, rng.integers(1, 25), p=chance / chance.sum()).tolist()
        rows.append((i, f"t{i % 3 % 2}", " ".join([*["the"] * int(rng.integers(1, 4)), *(["and"] if i % 50 else []), *own])))
    rows += [(i, "t0", "the and w250 w7") for i in range(3000, 3400)] + [(3400, "t1", ""), (3401, "t1", None)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, persona_id STRING, content STRING")
    asked = [(0, "the and w40 w41"), (1, "the the w250"), (2, "and the"), (3, "w1 w2 w3 the"), (4, "unknown"), (5, ""), (6, None), (7, "w299 and")]
    asked = spark.createDataFrame([(q, t, x) for q, x in asked for t in ("t0", "t1", "t2")], "query_id BIGINT, persona_id STRING, query STRING")
    out = {}
    for scope in ((), ("persona_id",)):
        path = str(tmp_path_factory.mktemp("index"))
        K.build_index(docs, scope=scope).write(path)
        out[scope] = K.KeywordIndex.read(spark, path, scope=scope)
    return out, asked


@pytest.mark.parametrize("scope", [(), ("persona_id",)])
@pytest.mark.parametrize("small", [True, False])
def test_pruned_search_gives_the_rows_of_search(frequent_terms, scope, small, monkeypatch):
    if not small:
        monkeypatch.setattr(K, "broadcast_if_small", lambda df, *a: df)
    index, asked = frequent_terms[0][scope], frequent_terms[1]
    asked = asked if scope else asked.where("persona_id = 't0'").drop("persona_id")
    key = lambda df: sorted((*[r[c] for c in scope], r.query_id, r.rank, r.doc_id, round(r.score, 6)) for r in df.collect())
    for k in (1, 10):
        assert key(K.search_pruned(index, asked, k)) == key(K.search(index, asked, k))


def test_pruned_search_reads_few_rows_of_frequent_terms(frequent_terms):
    index = frequent_terms[0][()]
    asked = K.query_terms(frequent_terms[1].where("persona_id = 't0' AND query_id IN (0, 1)"))
    impacts = K._impacts(index, asked.select("term").distinct(), K.K1, K.B)
    bounds = K.term_bounds(index, asked, impacts, 10)
    assert {(r.query_id, r.term) for r in bounds.where("free").collect()} == {(0, "and"), (0, "the"), (1, "the")}
    met = K.candidates(index, impacts, bounds, 10).where("query_id = 0").count()
    assert 10 <= met <= index.terms.where("term = 'the'").first().df / 10


def test_pruned_search_makes_no_row_for_a_query_and_a_posting(frequent_terms, monkeypatch):
    """Few query terms are scored where an index's postings of one document lie."""
    monkeypatch.setattr(K, "candidates", lambda *a: pytest.fail("postings joined with queries"))
    for cells in (K._CELLS, 40):
        monkeypatch.setattr(K, "_CELLS", cells)
        index, asked = frequent_terms[0][("persona_id",)], frequent_terms[1]
        found = {(r.persona_id, r.query_id, r.rank, r.doc_id, r.score) for r in K.search_pruned(index, asked, 7).collect()}
        assert found == {(r.persona_id, r.query_id, r.rank, r.doc_id, r.score) for r in K.search(index, asked, 7).collect()} and len(found) == 70


def test_stored_terms_are_counted_from_stored_postings(spark, corpus, tmp_path):
    """Texts are not split again for the terms."""
    index = K.build_index(corpus)
    want = sorted((r.term, r.df) for r in index.terms.collect())
    index.terms = None
    index.write(str(tmp_path / "ix"))
    assert want and sorted((r.term, r.df) for r in K.KeywordIndex.read(spark, str(tmp_path / "ix")).terms.collect()) == want


def test_pruned_search_of_nothing(spark, corpus, queries):
    assert K.search_pruned(K.build_index(corpus.limit(0)), queries).count() == 0
    assert K.search_pruned(K.build_index(corpus), queries.limit(0)).count() == 0


def test_index_survives_a_round_trip_and_grows(spark, corpus, queries, tmp_path):
    first, rest = K.build_index(corpus.where("doc_id < 3")), K.build_index(corpus.where("doc_id >= 3"))
    K.add_documents(first, rest).write(str(tmp_path / "ix"))
    back = K.KeywordIndex.read(spark, str(tmp_path / "ix"))
    key = lambda df: sorted((r.query_id, r.doc_id, r.score) for r in df.collect())
    assert key(K.search(back, queries)) == key(K.bm25_search(corpus, queries))


@pytest.mark.parametrize("bound", [5000, 0])
def test_nearest_equals_brute_force_with_a_hot_scope(spark, bound, monkeypatch):
    """Most vectors belong to one scope; the salted path gives the same result as the broadcast one."""
    monkeypatch.setattr(V, "MAX_BROADCAST_QUERIES", bound)
    monkeypatch.setattr(V, "VECTOR_BLOCK", 7)
    monkeypatch.setattr(V, "SALTS", 3)
    rnd = np.random.default_rng(5)
    x = rnd.standard_normal((120, 6)).astype("float32")
    x[7] = 0
    owner = ["hot" if i % 5 else "cold" for i in range(120)]
    vectors = spark.createDataFrame([(i, owner[i], x[i].tolist()) for i in range(120)], "doc_id BIGINT, persona_id STRING, embedding ARRAY<FLOAT>")
    qs = rnd.standard_normal((5, 6)).astype("float32")
    queries = spark.createDataFrame([(i, "hot" if i < 3 else "cold", qs[i].tolist()) for i in range(5)], "query_id BIGINT, persona_id STRING, query_vec ARRAY<FLOAT>")
    got = V.nearest(queries, vectors, 9, scope=["persona_id"]).collect()
    for q in range(5):
        sims = {
            i: round(float(x[i].astype(float) @ qs[q].astype(float) / (np.linalg.norm(x[i].astype(float)) * np.linalg.norm(qs[q].astype(float)) or 1)), 6)
            for i in range(120) if owner[i] == ("hot" if q < 3 else "cold")
        }
        want = sorted(sims.items(), key=lambda kv: (-kv[1], kv[0]))[:9]
        mine = [(r.doc_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)]
        assert [i for i, _ in mine] == [i for i, _ in want]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_approximate_search_finds_nine_of_ten(spark, sf):
    """The given vectors point anywhere, the hardest case for lists; still the defaults look at two thirds of them at most."""
    given = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    q = given.where("label = 3").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    r = V.recall_at_k(V.nearest(q, given, 10, id_col="vec_id"), V.nearest_approx(q, given, 10, id_col="vec_id"), "vec_id").first()
    assert r.found >= 0.9 * r.expected
    index = V.ListIndex.build(given, V.train_centroids(given, id_col="vec_id"), id_col="vec_id")
    listed = {r._list: r.n for r in index.blocks.groupBy("_list").agg(F.sum(F.size("_ids")).alias("n")).collect()}
    assert sum(listed.values()) == given.count()
    probed = q.select(V._near_lists(F.col("query_vec"), index.centroids, 40).alias("p")).collect()
    assert np.mean([sum(listed.get(i, 0) for i in r.p) for r in probed]) < 0.67 * given.count()


def test_lists_of_clustered_vectors(spark, tmp_path):
    """Where vectors gather, a few lists are enough; a stored index answers alike, inside the tenant only."""
    rnd = np.random.default_rng(1)
    centres = rnd.standard_normal((10, 16))
    x = np.repeat(centres, 20, axis=0) + 0.1 * rnd.standard_normal((200, 16))
    v = spark.createDataFrame([(i, "ab"[i % 2], x[i].tolist()) for i in range(200)] + [(200, "a", None)], "doc_id BIGINT, persona_id STRING, embedding ARRAY<DOUBLE>")
    q = spark.createDataFrame([(i, "ab"[i % 2], x[i * 20].tolist()) for i in range(10)] + [(1, "a", [0.0] * 16)], "query_id BIGINT, persona_id STRING, query_vec ARRAY<DOUBLE>")
    centroids = V.train_centroids(v, 20)
    index = V.ListIndex.build(v, centroids, scope=["persona_id"])
    index.write(str(tmp_path / "ix"))
    key = lambda df: sorted(map(tuple, df.select("persona_id", "query_id", "doc_id", "score", "rank").collect()))
    exact = V.nearest(q, v, 5, scope=["persona_id"])
    found = V.ListIndex.read(spark, str(tmp_path / "ix"), scope=["persona_id"]).search(q, 5, probe=4)
    near = lambda rows: {r[:3] for r in rows if r[3] > 0}
    assert len(near(key(found)) & near(key(exact))) >= 45 and key(found) == key(index.search(q, 5, probe=4))
    assert key(index.search(q, 5, probe=20)) == key(exact)
    zero = [r for r in key(exact) if r[:2] == ("a", 1) and r[3] == 0]
    assert [r[2] for r in zero] == [0, 2, 4, 6, 8]  # alike to none: smaller ids first, no more than k


def test_lists_without_vectors(spark):
    none = spark.createDataFrame([(1, None)], "doc_id BIGINT, embedding ARRAY<DOUBLE>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id BIGINT, query_vec ARRAY<DOUBLE>")
    assert V.nearest_approx(q, none, 3).count() == 0 and V.nearest_approx(q.limit(0), none.limit(0), 3).count() == 0


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id BIGINT, doc_id BIGINT, score DOUBLE, rank INT")


@pytest.mark.parametrize("scores,want", [([1, 2, 3, 4, 5], [0, 0.25, 0.5, 0.75, 1]), ([-2, -1, 0, 1, 2], [0, 0.25, 0.5, 0.75, 1]), ([5, 5, 5], [0.5] * 3), ([], [])])
def test_min_max(spark, scores, want):
    rows = [(0, i, float(s), 1) for i, s in enumerate(scores)]
    got = R.min_max(hits(spark, rows)).orderBy("doc_id").collect()
    assert [r.norm_score for r in got] == want


def test_fusion_weights():
    assert R.fusion_weights(0.3, 0.4) == pytest.approx((3 / 7, 4 / 7))
    assert R.fusion_weights(None, None) == pytest.approx((0.4, 0.6))
    assert R.fusion_weights(0, None) == (0.0, 1.0)


def test_reciprocal_ranks(spark):
    a = hits(spark, [(0, 1, 9.0, 1), (0, 2, 8.0, 2)])
    b = hits(spark, [(0, 1, 0.9, 1), (0, 3, 0.8, 2)])
    got = {r.doc_id: r.score for r in R.reciprocal_rank_fusion([a, b]).collect()}
    assert got == pytest.approx({1: 2 / 60, 2: 1 / 61, 3: 1 / 61}, abs=1e-6)


def test_confidence_weighting_uses_half_where_missing(spark):
    df = spark.createDataFrame([(0, 1, 0.8, 1, None), (0, 2, 0.7, 2, 1.0)], "query_id BIGINT, doc_id BIGINT, score DOUBLE, rank INT, confidence_score DOUBLE")
    got = RR.weight_by_confidence(df).orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in got] == [(2, 0.82), (1, 0.68)]


def test_failed_scorer_keeps_order(spark):
    def load():
        raise RuntimeError("no model")

    df = spark.createDataFrame([(0, 5, 1, "q", "b"), (0, 4, 2, "q", "a")], "query_id BIGINT, doc_id BIGINT, rank INT, query STRING, content STRING")
    got = RR.rerank(df, 2, score_pairs=M.model_pair_score(load)).orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in got] == [(5, 1.0), (4, 1.0)]


def test_pair_model_scores_by_length(spark):
    df = spark.createDataFrame([(0, 1, 1, "q", "aa"), (0, 2, 2, "q", "aaaa")], "query_id BIGINT, doc_id BIGINT, rank INT, query STRING, content STRING")
    got = RR.rerank(df, 1, score_pairs=M.model_pair_score(lambda: lambda pairs: [len(t) for _, t in pairs])).collect()
    assert [r.doc_id for r in got] == [2]


def test_embedder_by_language(spark):
    embed = M.by_language({"en": M.hashed_embedding(8), "zh": lambda c: F.array(F.lit(9.0).cast("float"))})
    df = spark.createDataFrame([("aa bb", "en"), ("x", "zh"), ("cc", "fr")], "t STRING, l STRING")
    got = [r[0] for r in df.select(embed(F.col("t"), F.col("l"))).collect()]
    assert sum(got[0]) == 2 and got[1] == [9.0] and sum(got[2]) == 1


def test_stages_can_be_switched_off_and_fall_back(spark, corpus, queries):
    embed = M.hashed_embedding(32)
    docs = corpus.where(F.trim("content") != "")
    full = P.advanced_search(queries, docs, embed, 2)
    assert {r.method for r in full.collect()} == {"hybrid+rerank"}
    plain = P.advanced_search(queries, docs, embed, 2, use_hybrid=False, use_reranking=False)
    assert {r.method for r in plain.collect()} == {"vector"}
    some = plain.where("query_id = 1")
    filled = P.with_fallback(some, queries.select("query_id", embed(F.col("query")).alias("query_vec")), docs.select("doc_id", embed(F.col("content")).alias("embedding")), 2)
    assert {r.query_id: r.method for r in filled.collect()} == {0: "fallback_vector", 1: "vector", 2: "fallback_vector", 3: "fallback_vector"}


@pytest.mark.parametrize("query,want", [("How to start", "tutorial_style"), ("Compare A and B", "comparison"), ("hello", "detailed_explanation"), ("what is x", "concept_explanation")])
def test_template_choice(spark, query, want):
    df = spark.createDataFrame([(query,)], "q STRING")
    assert df.select(P.choose_template(F.col("q"))).first()[0] == want


def test_score_ranges_count_every_vector(spark, monkeypatch):
    """More vectors than a block and than the k of any search; null vectors are left out, both join paths agree."""
    rng = np.random.default_rng(4)
    v = rng.standard_normal((300, 6)).round(3)
    vectors = spark.createDataFrame([(i, x.tolist() if i else None) for i, x in enumerate(v)], "doc_id bigint, embedding array<double>")
    queries = spark.createDataFrame([(i, v[i].tolist()) for i in (3, 7)], "query_id bigint, query_vec array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    monkeypatch.setattr(V, "VECTOR_BLOCK", 64)
    monkeypatch.setattr(V, "nearest", None)  # no ranked list on the way
    for bound in (5_000, 0):
        monkeypatch.setattr(V, "MAX_BROADCAST_QUERIES", bound)
        got = {r.query_id: (r.pairs, r.best, r.worst) for r in V.score_ranges(queries, vectors).collect()}
        for i in (3, 7):
            s = unit[1:] @ unit[i]
            assert got[i] == (299, pytest.approx(s.max(), abs=1e-6), pytest.approx(s.min(), abs=1e-6))


def test_salted_copies_of_queries_are_not_broadcast(spark, monkeypatch):
    """The salted path copies every query block for each salt, which the planner's estimates do not count."""
    vectors = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(50)], "doc_id bigint, embedding array<double>")
    queries = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(4)], "query_id bigint, query_vec array<double>")
    monkeypatch.setattr(V, "MAX_BROADCAST_QUERIES", 0)
    for out in (V.nearest(queries, vectors, 3), V.score_ranges(queries, vectors)):
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def tenants(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"persona_id STRING, query_id BIGINT, {extra}")


def test_search_knowledge_keeps_tenants_apart(spark):
    """Two tenants use the same query ids and the same document ids; each gets its own two records."""
    docs = spark.createDataFrame(
        [(t, f"d{i}", f"{t} record {i} about spark", 0.5 + i / 10, ["e"]) for t in ("a", "b") for i in range(4)],
        "persona_id STRING, document_id STRING, content STRING, confidence_score DOUBLE, supporting_evidence ARRAY<STRING>")
    queries = tenants(spark, [("a", 1, "spark record"), ("b", 1, "spark record"), ("b", 2, "about")], "query STRING")
    for on in (True, False):
        got = P.search_knowledge(queries, docs, M.hashed_embedding(16), 2, use_reranking=on).collect()
        assert sorted((r.persona_id, r.query_id, r["rank"]) for r in got) == [(t, q, n) for t, q in (("a", 1), ("b", 1), ("b", 2)) for n in (1, 2)]
        assert all(r.content.startswith(r.persona_id + " ") for r in got)


def test_list_functions_keep_tenants_apart(spark):
    from marginalia.functions import replies
    from marginalia.operators import tfidf

    keys = ["persona_id", "query_id"]
    a = tenants(spark, [("a", 1, 10, 0.9, 1, "A10"), ("a", 1, 11, 0.8, 2, "A11"), ("b", 1, 10, 0.7, 1, "B10")], "doc_id BIGINT, score DOUBLE, rank INT, content STRING")
    b = tenants(spark, [("a", 1, 11, 0.9, 1, "A11"), ("b", 1, 10, 0.7, 1, "B10"), ("b", 1, 12, 0.1, 2, "B12")], "doc_id BIGINT, score DOUBLE, rank INT, content STRING")
    runs = {(r.persona_id, r.doc_id): (r.rank_a, r.rank_b) for r in R.compare_runs(a, b, keys=keys).collect()}
    assert runs == {("a", 10): (1, None), ("a", 11): (2, 1), ("b", 10): (1, 1), ("b", 12): (None, 2)}
    assert {r.persona_id: r.overlap for r in R.overlap_at_k(a, b, 1, keys=keys).collect()} == {"a": 0.0, "b": 1.0}
    weighted = RR.weight_by_confidence(a.withColumn("confidence_score", F.col("rank") * 0.9), keys=keys).collect()
    assert sorted((r.persona_id, r.doc_id, r["rank"]) for r in weighted) == [("a", 10, 2), ("a", 11, 1), ("b", 10, 1)]
    asked = tenants(spark, [("a", 1, "q"), ("b", 1, "q"), ("c", 1, "q")], "query STRING")
    assert {r.persona_id: r.text for r in replies.format_results(asked, a, "core_beliefs", keys=keys).collect()} == {
        "a": "1. A10\n\n2. A11", "b": "1. B10", "c": replies.EMPTY_TEXTS["core_beliefs"]}
    texts = {r.persona_id: r.context for r in tfidf.excerpt_context(asked, a, empty="-", keys=keys).collect()}
    assert texts == {"a": "EXCERPT 1:\nA10\n\nEXCERPT 2:\nA11", "b": "EXCERPT 1:\nB10", "c": "-"}
    ids = {(r.persona_id, r.kind): list(r.ids) for r in P.collect_context(keys, x=a.withColumnRenamed("doc_id", "id"), y=b.withColumnRenamed("doc_id", "id")).collect()}
    assert ids == {("a", "x"): ["10", "11"], ("b", "x"): ["10"], ("a", "y"): ["11"], ("b", "y"): ["10", "12"]}
    assert P.query_variants(asked, 2, keys=keys).count() == 6
    vectors = spark.createDataFrame([("a", 10, [1.0, 0.0]), ("a", 11, [0.0, 1.0]), ("b", 10, [1.0, 0.0])], "persona_id STRING, doc_id BIGINT, embedding ARRAY<DOUBLE>")
    wanted = tenants(spark, [("a", 1, [0.0, 1.0]), ("b", 1, [1.0, 0.0])], "query_vec ARRAY<DOUBLE>")
    again = V.rerank_by_vector(a, wanted, vectors, 1, scope=["persona_id"]).collect()
    assert sorted((r.persona_id, r.doc_id, r.score) for r in again) == [("a", 11, 1.0), ("b", 10, 1.0)]


def test_advanced_search_drops_copies_once(spark):
    """Keyword search, vectors and the lookup of texts read the kept documents, not the shuffle that finds their copies."""
    from checks.search import CHECKS

    plan = CHECKS["ret_12_advanced_search"][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "_fp" not in plan


def test_embedding_makes_strings_of_different_terms_only():
    """Counts by hand, over runs that are cut inside the batch, with null, empty and repeated terms."""
    import hashlib

    import pyarrow as pa

    rows = [["a", "b", "a"], None, [], ["ä"] * 7, ["c"], *[["d", "e"]] * 9]
    place = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 8
    want = [[float(sum(place(t) == i for t in r or [])) for i in range(8)] for r in rows]
    terms, cells = M._EMBED_TERMS, M._EMBED_CELLS
    try:
        M._EMBED_TERMS, M._EMBED_CELLS = 5, 24
        batch = pa.array(rows, pa.list_(pa.string()))
        assert M.bucket_counts(batch, 8).to_pylist() == want
        assert M.bucket_counts(batch.slice(3, 5), 8).to_pylist() == want[3:8]
        assert M.bucket_counts(batch.slice(0, 0), 8).to_pylist() == []
    finally:
        M._EMBED_TERMS, M._EMBED_CELLS = terms, cells


def test_few_queries_meet_vectors_where_they_lie(spark):
    """One Python stage reads and scores the vectors: no block of them is handed on to be joined; same rows as the join."""
    rng = np.random.default_rng(2)
    vectors = spark.createDataFrame(
        [(i, f"t{i % 3}" if i % 7 else None, [float(x) for x in rng.integers(-2, 3, 4)] if i % 11 else None) for i in range(600)], "doc_id LONG, t STRING, embedding ARRAY<FLOAT>")
    queries = spark.createDataFrame([(i, f"t{i % 4}", [0.0] * 4 if i == 5 else [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(20)], "query_id LONG, t STRING, query_vec ARRAY<FLOAT>")
    for scope in ([], ["t"]):
        found = V.nearest(queries, vectors, 3, scope=scope)
        assert "_matrix" not in found._jdf.queryExecution().optimizedPlan().toString()
        joined = V.ranking.best(
            V._scored(V._block_pairs(queries, vectors, scope, "doc_id", "embedding", "query_vec"), scope, queries.schema["query_id"], vectors.schema["doc_id"], 3),
            [*scope, "query_id"], 3)
        assert sorted(found.collect(), key=str) == sorted(joined.select(found.columns).collect(), key=str) and found.count()


def test_python_gets_small_batches(spark, tmp_path):
    """A split of 40 MB of text reaches Python in parts, whatever the session's own setting."""
    from checks.base import table

    spark.range(10_000).select(F.col("id").alias("doc_id"), F.concat(F.col("id").cast("string"), F.lit("x" * 4_000)).alias("text")).coalesce(1).write.parquet(
        str(tmp_path / "documents.parquet"))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
    rows = table(spark, str(tmp_path), "documents").coalesce(1).mapInArrow(lambda it: (pa.record_batch({"n": [b.nbytes], "rows": [b.num_rows]}) for b in it), "n BIGINT, rows BIGINT")
    sizes = [(r.n, r.rows) for r in rows.collect()]
    assert sum(r for _, r in sizes) == 10_000 and max(n for n, _ in sizes) < 9 << 20
