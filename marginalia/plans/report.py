"""Reports: one row per tenant from many measures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import linguistics as L
from ..operators import vector_search

SCOPE = "persona_id"


def _as_map(rows: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Ranked rows (at most the report's top n) as a map in rank order, with the keys as an array too."""
    items = F.array_sort(F.collect_list(F.struct("rank", F.col(key).alias("k"), F.col(value).alias("v"))))
    return rows.groupBy(SCOPE).agg(items.alias("_i")).select(
        SCOPE, F.map_from_arrays(F.transform("_i", lambda x: x["k"]), F.transform("_i", lambda x: x["v"])).alias(out)
    )


def corpus_report(docs: DataFrame, *, entities: DataFrame | None = None, language: str = "language") -> DataFrame:
    """Totals for every tenant; keywords, collocations, readability, patterns and sentiment from its English
    documents. Other languages are counted only."""
    words = T.count_words(F.col("content"), F.col(language))
    totals = docs.groupBy(SCOPE).agg(F.count("*").alias("total_documents"), F.sum(words).alias("total_words"), F.sum(F.length("content")).alias("total_chars"))
    english = docs.where(F.col(language) == "en")
    collocations = L.collocations(english)
    ranked = F.array_sort(F.collect_list(F.struct("rank", F.struct("ngram", "kind", "frequency", "score").alias("c"))))
    parts = [
        _as_map(L.keywords(english), "term", "score", "top_keywords"),
        collocations.groupBy(SCOPE).agg(F.transform(ranked, lambda x: x["c"]).alias("top_collocations")),
        L.readability(english).select(SCOPE, "total_sentences", "flesch_reading_ease", "flesch_kincaid_grade"),
        L.sentence_patterns(english).select(SCOPE, "question_ratio", "exclamation_ratio", "median_len"),
        L.sentiment(english).select(SCOPE, "overall_sentiment"),
    ]
    if entities is not None:
        parts.append(_as_map(L.entity_counts(entities), "entity", "mentions", "top_entities"))
    out = totals
    for part in parts:
        out = out.join(part, SCOPE, "left")
    themes = L.content_themes(F.transform("top_collocations", lambda c: c["ngram"]))
    keyword_text = F.array_join(F.map_keys("top_keywords"), " ")
    entity_text = F.array_join(F.map_keys("top_entities"), " ") if entities is not None else F.lit("")
    return out.withColumns({
        "expertise_domains": L.expertise_domains(keyword_text, entity_text),
        "content_themes": F.coalesce(themes, F.array().cast("array<string>")),
    })


def nearest_chunk_report(chunks: DataFrame, embed: Callable[[Column], Column], query: str, k: int = 100, *, id_col: str = "chunk_id") -> DataFrame:
    """Figures of each tenant's `k` chunks nearest to one query."""
    tenants = chunks.select(SCOPE).distinct().select(SCOPE, F.col(SCOPE).alias("query_id"))
    q = tenants.withColumn("query_vec", embed(F.lit(query)))
    found = vector_search.nearest(q, chunks.select(SCOPE, id_col, embed(F.col("content")).alias("_v")), k, id_col=id_col, vec="_v", scope=[SCOPE])
    rows = chunks.join(found.select(id_col), id_col, "left_semi")
    base = rows.groupBy(SCOPE).agg(F.count("*").alias("chunks"), F.sum("word_count").alias("words"), F.count_distinct("parent_source").alias("documents"))
    return base.join(L.readability(rows).select(SCOPE, "flesch_reading_ease"), SCOPE, "left")


def tenant_overview(records: DataFrame, index_stats: DataFrame, cache_stats: DataFrame, run_stats: DataFrame) -> DataFrame:
    """Index sizes, cache rates and run times side by side; a tenant missing in one part keeps its row."""
    out = records
    for part in (index_stats, cache_stats, run_stats):
        out = out.join(part, SCOPE, "full_outer")
    return out
