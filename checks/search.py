"""Registered queries: joins, retrieval and scoring, top-k."""

from pyspark.sql import functions as F

from marginalia.operators import chunking as C
from marginalia.operators import keyword_search as K
from marginalia.operators import models as M
from marginalia.operators import ranking as R
from marginalia.operators import rerank as RR
from marginalia.operators import tfidf
from marginalia.operators import vector_search as V
from marginalia.plans import retrieval as P
from marginalia.session import kept_table, scratch_path

from .base import (
    SQL_CORPUS, SQL_QUERIES, corpus, queries_table, sql_chunks, sql_strip, sql_tokens, table,
)

CHECKS = {}
DIM = 64
EMBED = M.hashed_embedding(DIM)


def unique_docs(spark, sf):
    from marginalia.operators.dedup import first_per_fingerprint

    return first_per_fingerprint(corpus(spark, sf), order=["doc_id"])


SQL_UNIQUE = f"""fp AS (SELECT *, row_number() OVER (PARTITION BY lower({sql_strip('content')}) ORDER BY doc_id) AS rn FROM corpus WHERE {sql_strip('content')} <> ''),
  uniq AS (SELECT doc_id, persona_id, source, language, content FROM fp WHERE rn = 1)"""


def chunks(spark, sf):
    return C.word_chunks(unique_docs(spark, sf), 100, 20)


SQL_CH = f"{SQL_CORPUS}, {SQL_UNIQUE}, {sql_chunks(100, 20, 'uniq')}, {SQL_QUERIES}"


def sql_bm25(docs: str, idc: str, k: int, scope: str = "", q: str = "queries", name: str = "bm25", tokens=sql_tokens) -> str:
    """CTE `name(query_id, idc, score, rank)`; `scope` is a column of both sides."""
    s = f"{scope}, " if scope else ""
    on = f"USING ({s}term)"
    stats = f"JOIN {name}_st USING ({scope})" if scope else f"CROSS JOIN {name}_st"
    grp = f"GROUP BY {scope}" if scope else ""
    return f"""{name}_d AS (SELECT {s}{idc}, {tokens('content')} AS toks FROM {docs} WHERE {sql_strip('content')} <> ''),
  {name}_st AS (SELECT {s}count(*) AS n, avg(len(toks)) AS avgdl FROM {name}_d {grp}),
  {name}_tf AS (SELECT {s}{idc}, len(toks) AS dl, term, count(*) AS tf FROM (SELECT {s}{idc}, toks, unnest(toks) AS term FROM {name}_d) GROUP BY ALL),
  {name}_df AS (SELECT {s}term, count(*) AS df FROM {name}_tf GROUP BY ALL),
  {name}_qt AS (SELECT {s}query_id, term, count(*) AS qtf FROM (SELECT {s}query_id, unnest({tokens('query')}) AS term FROM {q}) GROUP BY ALL),
  {name}_sc AS (SELECT query_id, {idc}, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
    FROM {name}_qt JOIN {name}_tf {on} JOIN {name}_df {on} {stats} GROUP BY query_id, {idc}),
  {name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {idc}) AS rank FROM {name}_sc WHERE score > 0) WHERE rank <= {k})"""


def sql_embed(c: str) -> str:
    b = f"list_transform({sql_tokens(c)}, lambda t: (('0x' || substr(md5(t), 1, 8))::BIGINT % {DIM}))"
    return f"list_transform(generate_series(0, {DIM - 1}), lambda i: len(list_filter({b}, lambda x: x = i))::DOUBLE)"


def sql_vectors(name: str, src: str, cols: str, c: str = "content") -> str:
    """CTE of (cols, v): hashed embeddings, buckets counted once per row by histogram."""
    return f"""{name}_t AS (SELECT row_number() OVER () AS _r, * FROM {src}),
  {name}_b AS (SELECT _r, (('0x' || substr(md5(t), 1, 8))::BIGINT % {DIM}) AS b, count(*)::DOUBLE AS c FROM (SELECT _r, unnest({sql_tokens(c)}) AS t FROM {name}_t) GROUP BY ALL),
  {name}_m AS (SELECT _r, map_from_entries(list((b, c))) AS m FROM {name}_b GROUP BY _r),
  {name} AS (SELECT {cols}, list_transform(generate_series(0, {DIM - 1}), lambda i: coalesce(m[i], 0.0)::DOUBLE) AS v FROM {name}_t LEFT JOIN {name}_m USING (_r))"""


COS = """CASE WHEN list_dot_product({a}, {a}) = 0 OR list_dot_product({b}, {b}) = 0 THEN 0 ELSE
 list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))) END"""


def sql_nearest(name: str, qv: str, dv: str, idc: str, k: int, scope: str = "") -> str:
    join = f"JOIN {dv} d USING ({scope})" if scope else f"CROSS JOIN {dv} d"
    return f"""{name} AS (SELECT * FROM (SELECT query_id, {idc}, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {idc}) AS rank FROM (
    SELECT query_id, {idc}, round({COS.format(a='q.v', b='d.v')}, 6) AS score FROM {qv} q {join})) WHERE rank <= {k})"""


def sql_overlap(q: str, t: str) -> str:
    ql = f"list_distinct({sql_tokens(q)})"
    return f"CASE WHEN len({ql}) = 0 THEN 0 ELSE len(list_intersect({ql}, {sql_tokens(t)}))::DOUBLE / len({ql}) END"


def hits(df, idc="chunk_id"):
    return df.select("query_id", idc, "score", "rank")


CHECKS["ret_01_bm25_chunks"] = (
    lambda spark, sf: hits(K.bm25_search(chunks(spark, sf), queries_table(spark, sf), 5, id_col="chunk_id")),
    f"WITH {SQL_CH}, {sql_bm25('chunks', 'chunk_id', 5)} SELECT query_id, chunk_id, score, rank FROM bm25",
)


def _full_index(spark, sf):
    return K.build_index(corpus(spark, sf))


CHECKS["ret_01_bm25_documents"] = (
    lambda spark, sf: hits(K.search(_full_index(spark, sf), queries_table(spark, sf), 20), "doc_id"),
    f"WITH {SQL_CORPUS}, {SQL_QUERIES}, {sql_bm25('corpus', 'doc_id', 20)} SELECT query_id, doc_id, score, rank FROM bm25",
)


def _pruned_search(spark, sf):
    path = scratch_path(spark, "index")
    _full_index(spark, sf).write(path)
    return hits(K.search_pruned(K.KeywordIndex.read(spark, path), queries_table(spark, sf), 20), "doc_id")


CHECKS["ret_01_bm25_pruned"] = (_pruned_search, CHECKS["ret_01_bm25_documents"][1])


def _grown_index(spark, sf):
    docs = corpus(spark, sf)
    return K.add_documents(K.build_index(docs.where(F.col("language") == "en")), K.build_index(docs.where(F.col("language") != "en")))


CHECKS["ret_01_bm25_added_documents"] = (
    lambda spark, sf: hits(K.search(_grown_index(spark, sf), queries_table(spark, sf), 20), "doc_id"),
    CHECKS["ret_01_bm25_documents"][1],
)


def tenant_queries(spark, sf):
    return queries_table(spark, sf).withColumn("persona_id", F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")))


SQL_TQ = "tq AS (SELECT query_id, query, 'src' || (query_id % 20) AS persona_id FROM queries)"
CHECKS["joi_08_tenant_isolation"] = (
    lambda spark, sf: hits(K.bm25_search(corpus(spark, sf), tenant_queries(spark, sf), 5, scope=["persona_id"]), "doc_id"),
    f"WITH {SQL_CORPUS}, {SQL_QUERIES}, {SQL_TQ}, {sql_bm25('corpus', 'doc_id', 5, 'persona_id', 'tq')} SELECT query_id, doc_id, score, rank FROM bm25",
)
# Chinese-style splitting into single characters, after a trip through storage, and English with stop words.
_CHARACTERS = lambda c: F.filter(F.split(F.lower(c), ""), lambda t: t.rlike("[a-z]"))
_STOP = ["the", "and", "of", "to", "in", "is", "that", "for", "with", "as"]


def _stored_index(spark, sf):
    path = scratch_path(spark, "index")
    docs = corpus(spark, sf).select("doc_id", F.regexp_replace("content", r"(\w)\w+", "$1").alias("content"))
    K.build_index(docs, tokens=_CHARACTERS, stop_words=["e", "t"]).write(path)
    return K.KeywordIndex.read(spark, path, tokens=_CHARACTERS)


CHECKS["ret_01_character_splitter"] = (
    lambda spark, sf: hits(K.search(_stored_index(spark, sf), queries_table(spark, sf), 5), "doc_id"),
    rf"""WITH {SQL_CORPUS}, {SQL_QUERIES}, firsts AS (SELECT doc_id, regexp_replace(content, '([0-9A-Za-z_])[0-9A-Za-z_]+', '\1', 'g') AS content FROM corpus),
    {sql_bm25('firsts', 'doc_id', 5, tokens=lambda c: f"list_filter(string_split(lower({c}), ''), lambda t: regexp_matches(t, '[a-z]') AND t NOT IN ('e', 't'))")}
    SELECT query_id, doc_id, score, rank FROM bm25""",
)
CHECKS["ret_01_stop_words"] = (
    lambda spark, sf: hits(K.bm25_search(corpus(spark, sf), queries_table(spark, sf), 5, stop_words=_STOP), "doc_id"),
    f"""WITH {SQL_CORPUS}, {SQL_QUERIES}, {sql_bm25('corpus', 'doc_id', 5, tokens=lambda c: f"list_filter({sql_tokens(c)}, lambda t: t NOT IN {tuple(_STOP)})")}
    SELECT query_id, doc_id, score, rank FROM bm25""",
)
CHECKS["joi_01_term_lookup"] = (
    lambda spark, sf: _full_index(spark, sf).postings.join(
        K.query_terms(queries_table(spark, sf)), "term").groupBy("query_id").agg(F.count("*").alias("matches"), F.sum("tf").alias("occurrences")),
    f"""WITH {SQL_CORPUS}, {SQL_QUERIES}, {sql_bm25('corpus', 'doc_id', 5)} SELECT query_id, count(*) AS matches, sum(tf)::BIGINT AS occurrences FROM bm25_qt JOIN bm25_tf USING (term) GROUP BY 1""",
)
CHECKS["joi_03_document_lookup"] = (
    lambda spark, sf: K.attach_documents(hits(K.bm25_search(corpus(spark, sf), queries_table(spark, sf), 5), "doc_id"), corpus(spark, sf), "doc_id", "content")
    .select("query_id", "doc_id", F.md5("content").alias("content")),
    f"WITH {SQL_CORPUS}, {SQL_QUERIES}, {sql_bm25('corpus', 'doc_id', 5)} SELECT query_id, doc_id, md5(content) AS content FROM bm25 JOIN corpus USING (doc_id)",
)
CHECKS["agg_20_index_statistics"] = (
    lambda spark, sf: K.index_statistics(_full_index(spark, sf)).select("n_docs", F.round("avg_len", 6).alias("avg_len"), "k1", "b"),
    f"WITH {SQL_CORPUS}, {SQL_QUERIES}, {sql_bm25('corpus', 'doc_id', 5)} SELECT n AS n_docs, round(avgdl, 6) AS avg_len, 1.5::DOUBLE AS k1, 0.75::DOUBLE AS b FROM bm25_st",
)


def vec_queries(spark, sf):
    """Every vector labelled 3 asks for its neighbours."""
    return table(spark, sf, "embeddings").where("label = 3").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))


def vec_rows(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", "embedding")


SQL_VEC = """qv AS (SELECT vec_id AS query_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label = 3), dv AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"""
CHECKS["ret_02_nearest_exact"] = (
    lambda spark, sf: hits(V.nearest(vec_queries(spark, sf), vec_rows(spark, sf), 5, id_col="vec_id"), "vec_id"),
    f"WITH {SQL_VEC}, {sql_nearest('nn', 'qv', 'dv', 'vec_id', 5)} SELECT query_id, vec_id, score, rank FROM nn",
)
CHECKS["joi_06_query_by_vector_scores"] = (
    lambda spark, sf: V.score_ranges(vec_queries(spark, sf), vec_rows(spark, sf), id_col="vec_id"),
    f"WITH {SQL_VEC}, s AS (SELECT query_id, round({COS.format(a='q.v', b='d.v')}, 6) AS score FROM qv q CROSS JOIN dv d) SELECT query_id, count(*) AS pairs, max(score) AS best, min(score) AS worst FROM s GROUP BY 1",
)
CHECKS["prj_11_search_by_source"] = (
    lambda spark, sf: hits(V.nearest(vec_queries(spark, sf), vec_rows(spark, sf).where("label = 3"), 10, id_col="vec_id"), "vec_id"),
    f"WITH {SQL_VEC}, d3 AS (SELECT * FROM dv WHERE label = 3), {sql_nearest('nn', 'qv', 'd3', 'vec_id', 10)} SELECT query_id, vec_id, score, rank FROM nn",
)


def _hyde_queries(spark, sf):
    """The search vector is the embedding of a stand-in answer; a third of the queries have none."""
    answer = lambda prompt: F.when(F.col("query_id") % 3 != 0, F.concat(F.lit("the "), F.reverse(F.col("query")), F.lit(" "), F.col("query")))
    return P.hypotheses(queries_table(spark, sf), answer)


SQL_HYDE = "hq AS (SELECT query_id, query, CASE WHEN query_id % 3 <> 0 THEN 'the ' || reverse(query) || ' ' || query ELSE query END AS search_text, query_id % 3 <> 0 AS hypothesis_used FROM queries)"
CHECKS["mod_03_hypothesis"] = (
    lambda spark, sf: _hyde_queries(spark, sf).select("query_id", "search_text", "hypothesis_used"),
    f"WITH {SQL_QUERIES}, {SQL_HYDE} SELECT query_id, search_text, hypothesis_used FROM hq",
)
CHECKS["ret_03_search_by_hypothesis"] = (
    lambda spark, sf: V.nearest(_hyde_queries(spark, sf).select("query_id", EMBED(F.col("search_text")).alias("query_vec")),
                                corpus(spark, sf).select("doc_id", EMBED(F.col("content")).alias("embedding")), 5)
    .join(_hyde_queries(spark, sf), "query_id").select("query_id", "doc_id", "score", "rank", "hypothesis_used", F.lit("hyde").alias("method")),
    f"""WITH {SQL_CORPUS}, {SQL_QUERIES}, {SQL_HYDE}, {sql_vectors('qv', 'hq', 'query_id, hypothesis_used', 'search_text')}, {sql_vectors('dv', 'corpus', 'doc_id')},
    {sql_nearest('nn', 'qv', 'dv', 'doc_id', 5)} SELECT query_id, doc_id, score, rank, hypothesis_used, 'hyde' AS method FROM nn JOIN hq USING (query_id)""",
)
CHECKS["mod_01_hashed_embedding"] = (
    lambda spark, sf: corpus(spark, sf).select("doc_id", F.array_join(F.transform(EMBED(F.col("content")), lambda x: x.cast("int").cast("string")), ",").alias("vector")),
    f"WITH {SQL_CORPUS}, {sql_vectors('dv', 'corpus', 'doc_id')} SELECT doc_id, array_to_string(list_transform(v, lambda x: x::INT), ',') AS vector FROM dv",
)
_LISTS = f"""WITH {SQL_CORPUS}, {SQL_QUERIES}, {sql_bm25('corpus', 'doc_id', 20)}, {sql_vectors('qv', 'queries', 'query_id', 'query')}, {sql_vectors('dv', 'corpus', 'doc_id')}, {sql_nearest('nn', 'qv', 'dv', 'doc_id', 20)}"""


def sql_norm(name: str, src: str) -> str:
    return f"""{name} AS (SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN 0.5 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS ns
      FROM {src} WINDOW w AS (PARTITION BY query_id))"""


def sql_fused(idc: str, k: int) -> str:
    return f"""{sql_norm('nb', 'bm25')}, {sql_norm('nv', 'nn')}, fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {idc}) AS rank FROM (
      SELECT query_id, {idc}, coalesce(nb.ns, 0) AS b, coalesce(nv.ns, 0) AS v, round(0.4 * coalesce(nb.ns, 0) + 0.6 * coalesce(nv.ns, 0), 6) AS score FROM nb FULL OUTER JOIN nv USING (query_id, {idc}))) WHERE rank <= {k})"""


def _lists(spark, sf, n=20):
    docs, q = corpus(spark, sf), queries_table(spark, sf)
    return (hits(K.bm25_search(docs, q, n), "doc_id"),
            hits(V.nearest(q.select("query_id", EMBED(F.col("query")).alias("query_vec")), docs.select("doc_id", EMBED(F.col("content")).alias("embedding")), n), "doc_id"))


CHECKS["joi_02_merge_lists"] = (
    lambda spark, sf: R.merge_lists(*_lists(spark, sf)),
    _LISTS + " SELECT query_id, doc_id, coalesce(bm25.score, 0) AS bm25_score, coalesce(nn.score, 0) AS vector_score FROM bm25 FULL OUTER JOIN nn USING (query_id, doc_id)",
)
CHECKS["win_02_min_max"] = (
    lambda spark, sf: R.min_max(_lists(spark, sf)[0]).select("query_id", "doc_id", F.round("norm_score", 6).alias("norm_score")),
    _LISTS + f", {sql_norm('nb', 'bm25')} SELECT query_id, doc_id, round(ns, 6) AS norm_score FROM nb",
)
CHECKS["ret_04_hybrid_weighted"] = (
    lambda spark, sf: P.hybrid(queries_table(spark, sf), corpus(spark, sf), 10, EMBED).select("query_id", "doc_id", "score", "rank"),
    _LISTS + f", {sql_fused('doc_id', 10)} SELECT query_id, doc_id, score, rank FROM fused",
)
CHECKS["ret_05_reciprocal_rank_fusion"] = (
    lambda spark, sf: P.hybrid(queries_table(spark, sf), corpus(spark, sf), 10, EMBED, fusion="rrf").select("query_id", "doc_id", "score", "rank"),
    _LISTS + """, u AS (SELECT query_id, doc_id, rank FROM bm25 UNION ALL SELECT query_id, doc_id, rank FROM nn), s AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (rank - 1 + 60)), 6) AS score FROM u GROUP BY ALL)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""",
)
_T_LISTS = f"""WITH {SQL_CORPUS}, {SQL_QUERIES}, {SQL_TQ}, {sql_bm25('corpus', 'doc_id', 20, 'persona_id', 'tq')}, {sql_vectors('qv', 'tq', 'query_id, persona_id', 'query')},
  {sql_vectors('dv', 'corpus', 'doc_id, persona_id')}, {sql_nearest('nn', 'qv', 'dv', 'doc_id', 20, 'persona_id')}"""
CHECKS["ret_04_hybrid_tenants"] = (
    lambda spark, sf: P.hybrid(tenant_queries(spark, sf), corpus(spark, sf), 10, EMBED, scope=["persona_id"]).select("query_id", "doc_id", "score", "rank"),
    _T_LISTS + f", {sql_fused('doc_id', 10)} SELECT query_id, doc_id, score, rank FROM fused",
)
CHECKS["ret_05_rank_fusion_tenants"] = (
    lambda spark, sf: P.hybrid(tenant_queries(spark, sf), corpus(spark, sf), 10, EMBED, fusion="rrf", scope=["persona_id"]).select("query_id", "doc_id", "score", "rank"),
    _T_LISTS + """, u AS (SELECT query_id, doc_id, rank FROM bm25 UNION ALL SELECT query_id, doc_id, rank FROM nn), s AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (rank - 1 + 60)), 6) AS score FROM u GROUP BY ALL)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""",
)
CHECKS["ret_12_advanced_tenants"] = (
    lambda spark, sf: P.advanced_search(tenant_queries(spark, sf), corpus(spark, sf), EMBED, 5, retrieval_k=10, scope=["persona_id"]).select("query_id", "doc_id", "score", "rank"),
    _T_LISTS + f""", {sql_fused('doc_id', 10)}, c AS (SELECT query_id, doc_id, fused.rank AS r0, round({sql_overlap('queries.query', 'content')}, 6) AS score FROM fused JOIN corpus USING (doc_id) JOIN queries USING (query_id))
    SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r0, doc_id) AS rank FROM c) WHERE rank <= 5""",
)
CHECKS["joi_07_compare_runs"] = (
    lambda spark, sf: R.compare_runs(*_lists(spark, sf)).na.fill(-1, ["rank_a", "rank_b"]).na.fill(0, ["shift"]),
    _LISTS + """ SELECT query_id, doc_id, coalesce(bm25.rank, -1) AS rank_a, coalesce(nn.rank, -1) AS rank_b, coalesce(bm25.rank - nn.rank, 0) AS shift, bm25.rank IS NOT NULL AND nn.rank IS NOT NULL AS in_both FROM bm25 FULL OUTER JOIN nn USING (query_id, doc_id)""",
)
CHECKS["joi_07_overlap_at_k"] = (
    lambda spark, sf: R.overlap_at_k(*_lists(spark, sf), 20),
    _LISTS + """ SELECT query_id, count(*) FILTER (bm25.rank IS NOT NULL AND nn.rank IS NOT NULL)::DOUBLE / greatest(count(bm25.rank), count(nn.rank), 1) AS overlap FROM bm25 FULL OUTER JOIN nn USING (query_id, doc_id) GROUP BY 1""",
)
_LISTS_OF = V.seeded_centroids(32, DIM)
_PROBE = 24
_VALUES = ", ".join(f"({i}, {[float(x) for x in c]}::DOUBLE[])" for i, c in enumerate(_LISTS_OF))
_IVF = f"""WITH {SQL_VEC}, cent AS (SELECT * FROM (VALUES {_VALUES}) t(list, c)),
  dl AS (SELECT vec_id, list FROM (SELECT vec_id, list, row_number() OVER (PARTITION BY vec_id ORDER BY round({COS.format(a='v', b='c')}, 6) DESC, list) AS r FROM dv, cent) WHERE r = 1),
  ql AS (SELECT query_id, list FROM (SELECT query_id, list, row_number() OVER (PARTITION BY query_id ORDER BY round({COS.format(a='v', b='c')}, 6) DESC, list) AS r FROM qv, cent) WHERE r <= {_PROBE}),
  al AS (SELECT query_id, vec_id, round({COS.format(a='q.v', b='d.v')}, 6) AS score FROM qv q, dv d),
  ap AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM al JOIN dl USING (vec_id) JOIN ql USING (query_id, list)) WHERE rank <= 10),
  ex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM al) WHERE rank <= 10)"""


def _by_lists(spark, sf, k):
    """Lists under given centroids, after a trip through storage."""
    path = scratch_path(spark, "lists")
    V.ListIndex.build(vec_rows(spark, sf), _LISTS_OF, id_col="vec_id").write(path)
    return V.ListIndex.read(spark, path, id_col="vec_id").search(vec_queries(spark, sf), k, probe=_PROBE)


CHECKS["ret_06_nearest_approx"] = (
    lambda spark, sf: hits(_by_lists(spark, sf, 10), "vec_id"),
    _IVF + " SELECT query_id, vec_id, score, rank FROM ap",
)
CHECKS["ret_06_recall"] = (
    lambda spark, sf: V.recall_at_k(V.nearest(vec_queries(spark, sf), vec_rows(spark, sf), 10, id_col="vec_id"), _by_lists(spark, sf, 10), "vec_id"),
    _IVF + " SELECT count(*) AS expected, count(ap.vec_id) AS found FROM ex LEFT JOIN ap USING (query_id, vec_id)",
)
CHECKS["ret_06_trained_lists"] = (
    lambda spark, sf: hits(V.nearest_approx(vec_queries(spark, sf), vec_rows(spark, sf), 10, id_col="vec_id"), "vec_id"),
    None,
)


def _candidates(spark, sf):
    return K.attach_documents(_lists(spark, sf)[0], corpus(spark, sf), "doc_id", "content").join(queries_table(spark, sf), "query_id")


_RR = _LISTS + f""", c AS (SELECT query_id, doc_id, bm25.rank AS r0, round({sql_overlap('query', 'content')}, 6) AS score FROM bm25 JOIN corpus USING (doc_id) JOIN queries USING (query_id)),
  rr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r0, doc_id) AS rank FROM c) WHERE rank <= 5)"""
CHECKS["ret_07_rerank"] = (
    lambda spark, sf: RR.rerank(_candidates(spark, sf), 5).select("query_id", "doc_id", "score", "rank"),
    _RR + " SELECT query_id, doc_id, score, rank FROM rr",
)


def _broken():
    raise RuntimeError("model not available")


CHECKS["ret_07_rerank_failed_model"] = (
    lambda spark, sf: RR.rerank(_candidates(spark, sf), 5, score_pairs=M.model_pair_score(_broken)).select("query_id", "doc_id", "score", "rank"),
    _LISTS + " SELECT query_id, doc_id, 1.0::DOUBLE AS score, rank FROM bm25 WHERE rank <= 5",
)
CHECKS["ret_08_rerank_by_vector"] = (
    lambda spark, sf: V.rerank_by_vector(_lists(spark, sf)[0], queries_table(spark, sf).select("query_id", EMBED(F.col("query")).alias("query_vec")),
                                         corpus(spark, sf).select("doc_id", EMBED(F.col("content")).alias("embedding")), 10),
    _LISTS + f""", s AS (SELECT query_id, doc_id, round({COS.format(a='qv.v', b='dv.v')}, 6) AS score FROM bm25 JOIN qv USING (query_id) JOIN dv USING (doc_id))
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""",
)


def _weighted(spark, sf):
    from .base import confidence

    return RR.weight_by_confidence(RR.rerank(_candidates(spark, sf), 5).join(confidence(spark, sf), "doc_id", "left"))


CHECKS["ret_09_confidence_weighting"] = (
    lambda spark, sf: _weighted(spark, sf).select("query_id", "doc_id", "score", "rank"),
    _RR + """, w AS (SELECT query_id, doc_id, round(0.6 * score + 0.4 * coalesce(0.5 + 0.5 * quality, 0.5), 6) AS score FROM rr LEFT JOIN labels USING (doc_id))
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM w""",
)
_ADV = f"""WITH {SQL_CH}, {SQL_HYDE}, sq AS (SELECT query_id, search_text AS query FROM hq), {sql_bm25('chunks', 'chunk_id', 50, '', 'sq')},
  {sql_vectors('qv', 'sq', 'query_id', 'query')}, {sql_vectors('dv', 'chunks', 'chunk_id')}, {sql_nearest('nn', 'qv', 'dv', 'chunk_id', 50)}, {sql_fused('chunk_id', 25)},
  c AS (SELECT query_id, chunk_id, fused.rank AS r0, round({sql_overlap('queries.query', 'content')}, 6) AS score FROM fused JOIN chunks USING (chunk_id) JOIN queries USING (query_id)),
  adv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r0, chunk_id) AS rank FROM c) WHERE rank <= 5)"""


def _advanced(spark, sf):
    kept = C.word_chunks(kept_table(unique_docs(spark, sf), "documents"), 100, 20)  # read three times, copies dropped once
    answer = lambda prompt: F.when(F.col("query_id") % 3 != 0, F.concat(F.lit("the "), F.reverse(F.col("query")), F.lit(" "), F.col("query")))
    return P.advanced_search(queries_table(spark, sf), kept, EMBED, 5, id_col="chunk_id", answer=answer)


CHECKS["ret_12_advanced_search"] = (
    lambda spark, sf: _advanced(spark, sf),
    _ADV + " SELECT query_id, chunk_id, score, rank, 'hyde+hybrid+rerank' AS method FROM adv",
)
CHECKS["ret_12_stages_off"] = (
    lambda spark, sf: P.advanced_search(queries_table(spark, sf), corpus(spark, sf), EMBED, 5, use_hyde=False, use_hybrid=False, use_reranking=False),
    _LISTS + " SELECT query_id, doc_id, score, rank, 'vector' AS method FROM nn WHERE rank <= 5",
)


def _fallback(spark, sf):
    q = queries_table(spark, sf)
    some = P.advanced_search(q.where("query_id % 2 = 0"), corpus(spark, sf), EMBED, 5, use_hyde=False, use_hybrid=False, use_reranking=False)
    return P.with_fallback(some, q.select("query_id", EMBED(F.col("query")).alias("query_vec")), corpus(spark, sf).select("doc_id", EMBED(F.col("content")).alias("embedding")), 5)


CHECKS["ret_13_fallback"] = (
    _fallback,
    _LISTS + " SELECT query_id, doc_id, score, rank, CASE WHEN query_id % 2 = 0 THEN 'vector' ELSE 'fallback_vector' END AS method FROM nn WHERE rank <= 5",
)


def tf_chunks(spark, sf):
    return C.fixed_char_chunks(corpus(spark, sf)).select(F.concat_ws("#", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"), "content")


def sql_grams(c: str) -> str:
    t = sql_tokens(c)
    return f"list_concat({t}, list_transform(generate_series(1, len({t}) - 1), lambda i: ({t})[i] || ' ' || ({t})[i + 1]))"


_TF = rf"""WITH {SQL_CORPUS}, {SQL_QUERIES}, s AS (SELECT doc_id, content AS c, unnest(generate_series(0, length(content) - 1, 800)) AS st FROM corpus WHERE length(content) > 0),
  docs AS (SELECT doc_id || '#' || (st // 800) AS chunk_id, {sql_strip('substring(c, st + 1, 1000)')} AS content FROM s WHERE length({sql_strip('substring(c, st + 1, 1000)')}) > 100),
  dt AS (SELECT chunk_id, {sql_tokens('content')} AS t FROM docs), qt AS (SELECT query_id, {sql_tokens('query')} AS t FROM queries),
  dg AS (SELECT chunk_id, unnest(list_concat(t, list_transform(generate_series(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM dt),
  qg AS (SELECT query_id, unnest(list_concat(t, list_transform(generate_series(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM qt),
  dc AS (SELECT chunk_id, term, count(*) AS tf FROM dg GROUP BY ALL), qc AS (SELECT query_id, term, count(*) AS tf FROM qg GROUP BY ALL),
  vocab AS (SELECT term, ln((1 + (SELECT count(*) FROM docs)) / (1 + count(*)::DOUBLE)) + 1 AS idf FROM dc GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 5000),
  dw AS (SELECT chunk_id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY chunk_id)) AS w FROM dc JOIN vocab USING (term)),
  qw AS (SELECT query_id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY query_id)) AS w FROM qc JOIN vocab USING (term)),
  sims AS (SELECT query_id, chunk_id, round(sum(dw.w * qw.w), 6) AS score FROM qw JOIN dw USING (term) GROUP BY ALL),
  top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sims) WHERE rank <= 10),
  tf AS (SELECT query_id, chunk_id, score, rank FROM (SELECT *, count(*) FILTER (score >= 0.1) OVER (PARTITION BY query_id) AS strong FROM top) WHERE rank <= 5 AND score >= CASE WHEN strong > 0 THEN 0.1 ELSE 0.05 END)"""
CHECKS["ret_14_tfidf_search"] = (
    lambda spark, sf: hits(tfidf.search(tf_chunks(spark, sf), queries_table(spark, sf), 5)),
    _TF + " SELECT query_id, chunk_id, score, rank FROM tf",
)


def _context(spark, sf):
    found = K.attach_documents(hits(tfidf.search(tf_chunks(spark, sf), queries_table(spark, sf), 5)), tf_chunks(spark, sf), "chunk_id", "content")
    return tfidf.excerpt_context(queries_table(spark, sf), found)


CHECKS["ret_15_excerpt_context"] = (
    _context,
    _TF + """, c AS (SELECT query_id, string_agg('EXCERPT ' || rank || ':' || chr(10) || content, chr(10) || chr(10) ORDER BY rank) AS context FROM tf JOIN docs USING (chunk_id) GROUP BY 1)
    SELECT query_id, coalesce(context, 'No relevant context found in the knowledge base.') AS context FROM queries LEFT JOIN c USING (query_id)""",
)
CHECKS["top_01_top_k"] = (
    lambda spark, sf: R.best(table(spark, sf, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("doc_id"), F.col("value").alias("score")), ["query_id"], 3).select("query_id", "doc_id", "rank"),
    "SELECT query_id, doc_id, rank FROM (SELECT user_id AS query_id, event_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 3",
)
CHECKS["set_03_query_variants"] = (
    lambda spark, sf: P.query_variants(queries_table(spark, sf), 3),
    f"""WITH {SQL_QUERIES} SELECT query_id, 0 AS variant, query FROM queries UNION ALL SELECT query_id, 1, replace('{P.QUERY_VARIANTS['reformulation']}', '{{query}}', query) FROM queries
    UNION ALL SELECT query_id, 2, replace('{P.QUERY_VARIANTS['context_expansion']}', '{{query}}', query) FROM queries""",
)


def _kinds(spark, sf):
    a, b = _lists(spark, sf, 3)
    return P.collect_context(lexical=a.withColumnRenamed("doc_id", "id"), dense=b.withColumnRenamed("doc_id", "id")).withColumn("ids", F.array_join("ids", ","))


CHECKS["set_04_collect_context"] = (
    _kinds,
    _LISTS + """, u AS (SELECT 'lexical' AS kind, query_id, doc_id, rank FROM bm25 WHERE rank <= 3 UNION ALL SELECT 'dense', query_id, doc_id, rank FROM nn WHERE rank <= 3)
    SELECT query_id, kind, count(*) AS results, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS ids FROM u GROUP BY ALL""",
)
