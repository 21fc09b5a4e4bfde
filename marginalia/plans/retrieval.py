"""Retrieval flows: whole tables of queries in, ranked results out. Every stage is an argument."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from ..operators import keyword_search, ranking, rerank as rr, vector_search
from ..operators.models import term_overlap

# Own wording; the keys decide which one a query gets.
HYPOTHESIS_TEMPLATES = {
    "tutorial_style": "Write the passage of a tutorial that walks through: {query}",
    "comparison": "Write a passage that weighs the options in: {query}",
    "best_practices": "Write a passage of proven practice about: {query}",
    "problem_solution": "Write a passage that names the cause and the fix for: {query}",
    "concept_explanation": "Write a passage that defines and explains: {query}",
    "framework_focused": "Write a passage that lays out a framework for: {query}",
    "technical_response": "Write a technical passage on: {query}",
    "factual_response": "Write a passage of facts and figures on: {query}",
    "detailed_explanation": "Write a detailed passage that answers: {query}",
}
QUERY_VARIANTS = {
    "reformulation": "State this question more clearly: {query}",
    "context_expansion": "Name the topics related to this question: {query}",
    "keyword_extraction": "List the key terms of this question: {query}",
    "step_back": "Name the principles behind this question: {query}",
    "decomposition": "Break this question into smaller ones: {query}",
    "generalization": "State the general form of this question: {query}",
    "specification": "Make this question concrete: {query}",
}
VARIANT_ORDER = ["reformulation", "context_expansion", "keyword_extraction"]


def choose_template(query: Column) -> Column:
    """Template key by the first matching keyword family."""
    return T.first_class(F.lower(query), fixed.TEMPLATE_RULES, "detailed_explanation")


def choose_task(task: Column) -> Column:
    return T.first_class(F.lower(task), fixed.TASK_RULES, "general")


def fill_template(key: Column, query: Column, templates: dict[str, str] | None = None, default: str | None = None) -> Column:
    templates = templates or HYPOTHESIS_TEMPLATES
    chosen = F.coalesce(T.lookup(key, templates), F.lit(templates[default or next(iter(templates))]))
    return F.replace(chosen, F.lit("{query}"), query)


def query_variants(
    queries: DataFrame, n: int = 3, templates: dict[str, str] | None = None, keys: Sequence[str] = ("query_id",),
) -> DataFrame:
    """The query and up to three templated variants, as rows (query_id, variant, query); `keys` name a query."""
    templates = templates or QUERY_VARIANTS
    names = VARIANT_ORDER[: max(0, min(n - 1, len(VARIANT_ORDER)))]
    items = [F.col("query")] + [F.replace(F.lit(templates[v]), F.lit("{query}"), F.col("query")) for v in names]
    return queries.select(*keys, F.posexplode(F.array(*items)).alias("variant", "query"))


def hypotheses(queries: DataFrame, answer: Callable[[Column], Column] | None) -> DataFrame:
    """Search text per query: the model's hypothetical answer, or the query itself where there is none."""
    if answer is None:
        return queries.withColumns({"search_text": F.col("query"), "hypothesis_used": F.lit(False)})
    prompt = fill_template(choose_template(F.col("query")), F.col("query"))
    rows = queries.withColumn("_answer", answer(prompt))
    usable = F.coalesce(T.strip(F.col("_answer")) != "", F.lit(False))
    return rows.withColumns(
        {"search_text": F.when(usable, F.col("_answer")).otherwise(F.col("query")), "hypothesis_used": usable}
    ).drop("_answer")


def hybrid(
    queries: DataFrame, docs: DataFrame, k: int, embed: Callable[[Column], Column], *, id_col: str = "doc_id",
    text: str = "content", vec: str | None = None, bm25_k: int | None = None, vector_k: int | None = None,
    weights: tuple[float | None, float | None] = (None, None), query_text: str = "query",
    index: keyword_search.KeywordIndex | None = None, fusion: str = "weighted", scope: Sequence[str] = (), **splitter,
) -> DataFrame:
    """Keyword and vector lists, each over-fetched, fused by weighted scores or reciprocal ranks.

    With `scope` (the tenant columns of queries and documents) a query sees its own tenant's documents only.
    `splitter` takes tokens and stop_words of a one-off keyword search.
    """
    nb, nv = ranking.fetch_sizes(k, bm25_k, vector_k)
    keys = [*scope, "query_id"]
    q = queries.select(*keys, F.col(query_text).alias("query"))
    if index is not None and list(index.scope) != list(scope):
        raise ValueError(f"the index is scoped by {list(index.scope)}, the search by {list(scope)}")
    if index is None:
        lexical = keyword_search.bm25_search(docs, q, nb, id_col=id_col, text=text, scope=scope, **splitter)
    else:
        lexical = keyword_search.search(index, q, nb)
    vectors = docs if vec else docs.select(*scope, id_col, embed(F.col(text)).alias("_vec"))
    dense = vector_search.nearest(
        q.select(*keys, embed(F.col("query")).alias("query_vec")), vectors, nv, id_col=id_col, vec=vec or "_vec", scope=scope,
    )
    if fusion == "rrf":
        return ranking.reciprocal_rank_fusion([lexical, dense], k, id_col=id_col, keys=keys)
    return ranking.weighted_fusion(
        lexical, dense, k, id_col=id_col, bm25_weight=weights[0], vector_weight=weights[1], keys=keys,
    )


def advanced_search(
    queries: DataFrame, docs: DataFrame, embed: Callable[[Column], Column], k: int = 5, *, retrieval_k: int = 25,
    id_col: str = "doc_id", text: str = "content", vec: str | None = None,
    answer: Callable[[Column], Column] | None = None,
    use_hyde: bool = True, use_hybrid: bool = True, use_reranking: bool = True,
    score_pairs: Callable[[Column, Column], Column] = term_overlap,
    index: keyword_search.KeywordIndex | None = None, scope: Sequence[str] = (), **splitter,
) -> DataFrame:
    """Hypothesis, hybrid candidates, re-ranking against the original query. Each stage can be off; `scope` as in
    `hybrid`, its columns come first in the result."""
    q = hypotheses(queries, answer if use_hyde else None)
    keys = [*scope, "query_id"]
    if use_hybrid:
        found = hybrid(q, docs, retrieval_k, embed, id_col=id_col, text=text, vec=vec, query_text="search_text",
                       index=index, scope=scope, **splitter)
    else:
        vectors = docs if vec else docs.select(*scope, id_col, embed(F.col(text)).alias("_vec"))
        found = vector_search.nearest(
            q.select(*keys, embed(F.col("search_text")).alias("query_vec")), vectors, retrieval_k,
            id_col=id_col, vec=vec or "_vec", scope=scope,
        )
    method = "+".join(n for n, on in (("hyde", use_hyde and answer is not None), ("hybrid", use_hybrid),
                                      ("vector", not use_hybrid), ("rerank", use_reranking)) if on)
    if use_reranking:
        # Candidates are at most retrieval_k per query: the texts are looked up for them alone.
        rows = keyword_search.attach_documents(found, docs, id_col, text).join(
            queries.select(*keys, "query"), keys
        )
        out = rr.rerank(rows, k, text=text, id_col=id_col, score_pairs=score_pairs, keys=keys)
    else:
        out = found.where(F.col("rank") <= k)
    return out.select(*keys, id_col, "score", "rank").withColumn("method", F.lit(method))


def with_fallback(results: DataFrame, queries: DataFrame, vectors: DataFrame, k: int, scope: Sequence[str] = (), **kw) -> DataFrame:
    """Queries without a result get the plain vector top k (of their own tenant, with `scope`), tagged as such."""
    keys = [*scope, "query_id"]
    missing = queries.join(results.select(*keys).distinct(), keys, "left_anti")
    plain = vector_search.nearest(missing, vectors, k, scope=scope, **kw).withColumn("method", F.lit("fallback_vector"))
    return results.unionByName(plain.select(*results.columns))


def knowledge_filter(
    docs: DataFrame, *, min_confidence: float = 0.0, category: str | None = None,
    categories: Sequence[str] | None = None, conviction: str | Sequence[str] | None = None,
) -> DataFrame:
    """Metadata predicates, applied before anything is ranked; all given ones must hold."""
    if min_confidence > 0:
        docs = docs.where(F.col("confidence_score") >= min_confidence)
    if category is not None:
        docs = docs.where(F.col("category") == category)
    if categories is not None:
        docs = docs.where(F.arrays_overlap("categories", F.array(*[F.lit(c) for c in categories])))
    if conviction is not None:
        levels = [conviction] if isinstance(conviction, str) else list(conviction)
        docs = docs.where(F.col("conviction_level").isin(levels))
    return docs


def search_knowledge(
    queries: DataFrame, docs: DataFrame, embed: Callable[[Column], Column], k: int = 5, *, retrieval_k: int = 20,
    use_reranking: bool = True, weight_confidence: bool = True, include_evidence: bool = True,
    score_pairs: Callable[[Column, Column], Column] = term_overlap, **filters,
) -> DataFrame:
    """Search knowledge records of the query's own tenant: filter, candidates, re-rank, confidence.

    Queries carry persona_id; records carry persona_id, document_id, content, confidence_score. A query is named by
    persona_id and query_id, a record by persona_id and document_id: tenants may use the same ids.
    """
    docs, keys = knowledge_filter(docs, **filters), ["persona_id", "query_id"]
    found = vector_search.nearest(
        queries.select(*keys, embed(F.col("query")).alias("query_vec")),
        docs.select("persona_id", "document_id", embed(F.col("content")).alias("_vec")),
        retrieval_k if use_reranking else k, id_col="document_id", vec="_vec", scope=["persona_id"],
    )
    rows = found.join(docs, ["persona_id", "document_id"]).join(queries.select(*keys, "query"), keys)
    if use_reranking:
        rows = rr.rerank(rows, k, id_col="document_id", score_pairs=score_pairs, keys=keys)
        if weight_confidence:
            rows = rr.weight_by_confidence(rows, id_col="document_id", keys=keys)
    return rows if include_evidence else hide_evidence(rows)


def hide_evidence(rows: DataFrame) -> DataFrame:
    """Empty evidence lists; no result is lost."""
    if "supporting_evidence" not in rows.columns:
        return rows
    return rows.withColumn("supporting_evidence", F.array().cast("array<string>"))


def high_conviction(queries: DataFrame, docs: DataFrame, embed, k: int = 10, strict: bool = False, **kw) -> DataFrame:
    """Beliefs held firmly: level high or very_high (only high when `strict`), confidence at least 0.8."""
    levels = ["high"] if strict else ["high", "very_high"]
    return search_knowledge(queries, docs, embed, k, conviction=levels, min_confidence=0.8, **kw)


def by_category(queries: DataFrame, docs: DataFrame, embed, category: str, k: int = 10, min_confidence: float = 0.7, **kw) -> DataFrame:
    return search_knowledge(queries, docs, embed, k, category=category, min_confidence=min_confidence, **kw)


def collect_context(keys: Sequence[str] = ("query_id",), **kinds: DataFrame) -> DataFrame:
    """Bring result kinds together, one row per query and kind with its count and its ids in rank order. `keys` name a
    query, with its tenant if any."""
    rows = None
    for kind, hits in kinds.items():
        part = hits.select(*keys, F.lit(kind).alias("kind"), "rank", F.col("id").cast("string").alias("id"))
        rows = part if rows is None else rows.unionByName(part)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"])
    return rows.groupBy(*keys, "kind").agg(F.count("*").alias("results"), ids.alias("ids"))
