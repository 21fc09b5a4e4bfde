"""Totals over documents, chunks and records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def corpus_totals(docs: DataFrame, scope: Sequence[str] = (), *, name: str = "source", words: str = "word_count", chars: str = "char_count") -> DataFrame:
    """Counts, sums, means, and the largest and smallest document (first name on a tie)."""
    order = F.struct(F.col(words).alias("w"), F.col(name).alias("n"))
    low = F.min(order)["n"]
    high = F.min(F.struct((-F.col(words)).alias("w"), F.col(name).alias("n")))["n"]
    return docs.groupBy(*scope).agg(
        F.count("*").alias("documents"),
        F.sum(words).alias("total_words"),
        F.sum(chars).alias("total_chars"),
        F.avg(words).alias("avg_words"),
        F.avg(chars).alias("avg_chars"),
        F.max(words).alias("max_words"),
        F.min(words).alias("min_words"),
        high.alias("largest"),
        low.alias("smallest"),
    )


def extension_counts(docs: DataFrame, scope: Sequence[str] = (), *, name: str = "source") -> DataFrame:
    return docs.groupBy(*scope, T.file_suffix(F.element_at(F.split(name, "/"), -1)).alias("extension")).agg(F.count("*").alias("documents"))


def chunk_totals(chunks: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    return chunks.groupBy(*scope).agg(
        F.count("*").alias("chunks"),
        F.sum("word_count").alias("total_words"),
        F.avg("word_count").alias("avg_words"),
        F.max("word_count").alias("max_words"),
        F.min("word_count").alias("min_words"),
        F.avg("char_count").alias("avg_chars"),
        F.count_distinct("parent_source").alias("parents"),
    )


def record_document_stats(docs: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    size = F.length("content")
    return docs.groupBy(*scope).agg(
        F.count("*").alias("documents"),
        F.avg(size).alias("avg_content_length"),
        F.min(size).alias("min_content_length"),
        F.max(size).alias("max_content_length"),
        F.avg("confidence_score").alias("avg_confidence"),
    )


def collection_rollup(rows: DataFrame) -> DataFrame:
    """Rows per tenant and knowledge type, per tenant, and overall (null keys mark the totals)."""
    return rows.rollup("persona_id", "knowledge_type").agg(
        F.count("*").alias("records"), F.grouping_id().alias("level")
    )


def book_statistics(chunks: DataFrame, book: str = "book") -> DataFrame:
    """Per book and overall: chunks, shortest, longest, whole-number mean."""
    return chunks.rollup(book).agg(
        F.count("*").alias("chunks"),
        F.min("word_count").alias("min_words"),
        F.max("word_count").alias("max_words"),
        F.floor(F.sum("word_count") / F.count("*")).alias("avg_words"),
        F.grouping_id().alias("level"),
    )


def distinct_categories(records: DataFrame, categories: str = "categories") -> DataFrame:
    """Every category once, sorted. Distinct runs before anything is brought together."""
    return records.select(F.explode(categories).alias("category")).distinct().orderBy("category")
