"""Filters of documents, chunks, knowledge records and conversations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def by_word_count(docs: DataFrame, low: int = 10, high: int | None = None, *, content: str = "content", language: Column | None = None, out: str = "word_count") -> DataFrame:
    """Documents of `low` to `high` words, with their count; characters are counted where the language has no spaces."""
    rows = docs.withColumn(out, T.count_words(F.col(content), language) if language is not None else T.count_words(F.col(content)))
    return rows.where((F.col(out) >= low) & (F.lit(True) if high is None else F.col(out) <= high))


def chunks_by_size(chunks: DataFrame, low: int = 10, high: int = 2000, *, words: str = "word_count") -> DataFrame:
    """Chunks whose stored word count is in range; no text is read."""
    return chunks.where(F.col(words).between(low, high))


def browse(
    records: DataFrame, *, min_confidence: float = 0.0, categories: Sequence[str] | None = None, search: str | None = None,
    fields: Sequence[str] = ("name", "description"),
) -> DataFrame:
    """Records of enough confidence, in any of the categories, with the search text (any case) in one of the fields."""
    keep = F.col("confidence_score") >= min_confidence
    if categories:
        keep = keep & F.arrays_overlap("categories", F.array(*[F.lit(c) for c in categories]))
    if search:
        hits = [F.contains(F.lower(f), F.lit(search.lower())) for f in fields]
        found = hits[0]
        for hit in hits[1:]:
            found = found | hit
        keep = keep & found
    return records.where(keep)


def in_category(records: DataFrame, category: str) -> DataFrame:
    """Records with the category, in any case."""
    return records.where(F.exists("categories", lambda c: F.lower(c) == category.lower()))


def conversation(messages: DataFrame, conv_id: object, *, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Messages of one conversation in order; the filter reaches the scan."""
    return messages.where(F.col(key) == conv_id).orderBy(turn)


def outcome(failed: Column, skipped: Column) -> Column:
    """State of a file of a batch: failed before skipped before processed; null counts as false."""
    return F.when(F.coalesce(failed, F.lit(False)), "failed").when(F.coalesce(skipped, F.lit(False)), "skipped").otherwise("processed")


def batch_counters(files: DataFrame, status: Column) -> DataFrame:
    """(status, files): how many files ended in which state."""
    return files.groupBy(status.alias("status")).agg(F.count("*").alias("files"))
