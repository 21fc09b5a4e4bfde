"""Ranking, normalising and fusing result lists. A result list is (query_id, id, score, rank)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCORE_DIGITS = 6


def rounded(score: Column) -> Column:
    """Scores are rounded before they rank, so a different summation order cannot swap two results."""
    return F.round(score, SCORE_DIGITS)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """Best `k` rows per key. Planned with a group limit on each side of the shuffle, so a hot key sends
    at most `k` rows per task."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def best(df: DataFrame, keys: Sequence[str], k: int, id_col: str = "doc_id", score: str = "score") -> DataFrame:
    return top_k(df, keys, [F.desc(score), F.asc(id_col)], k)


def min_max(df: DataFrame, keys: Sequence[str] = ("query_id",), score: str = "score", out: str = "norm_score") -> DataFrame:
    """Scale each list to 0..1; a list of equal scores becomes 0.5. Lists are already cut to k rows."""
    w = Window.partitionBy(*keys)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return df.withColumn(
        out, F.when(high == low, F.lit(0.5)).otherwise(F.try_divide(F.col(score) - low, high - low))
    )


def fusion_weights(bm25: float | None, vector: float | None) -> tuple[float, float]:
    """Defaults 0.4 / 0.6, rescaled to sum 1. `None` asks for the default, 0 means 0."""
    b = 0.4 if bm25 is None else bm25
    v = 0.6 if vector is None else vector
    total = b + v
    return (b / total, v / total) if total else (0.0, 0.0)


def merge_lists(
    bm25: DataFrame, vector: DataFrame, id_col: str = "doc_id", score: str = "score", keys: Sequence[str] = ("query_id",),
) -> DataFrame:
    """Both scores per (keys, id), 0 where a list misses the id.

    A union followed by one aggregation: same rows as a full outer join with one shuffle instead of two.
    """
    left = bm25.select(*keys, id_col, F.col(score).alias("bm25_score"), F.lit(None).cast("double").alias("vector_score"))
    right = vector.select(*keys, id_col, F.lit(None).cast("double").alias("bm25_score"), F.col(score).alias("vector_score"))
    return (
        left.unionByName(right)
        .groupBy(*keys, id_col)
        .agg(
            F.coalesce(F.max("bm25_score"), F.lit(0.0)).alias("bm25_score"),
            F.coalesce(F.max("vector_score"), F.lit(0.0)).alias("vector_score"),
        )
    )


def weighted_fusion(
    bm25: DataFrame, vector: DataFrame, k: int = 20, *, id_col: str = "doc_id",
    bm25_weight: float | None = None, vector_weight: float | None = None, keys: Sequence[str] = ("query_id",),
) -> DataFrame:
    """Min-max both lists and rank by the weighted sum. `keys` name a list: the query, and its tenant if any."""
    wb, wv = fusion_weights(bm25_weight, vector_weight)
    merged = merge_lists(min_max(bm25, keys), min_max(vector, keys), id_col, "norm_score", keys)
    scored = merged.withColumn("score", rounded(F.col("bm25_score") * wb + F.col("vector_score") * wv))
    return best(scored, keys, k, id_col)


def reciprocal_rank_fusion(
    lists: Sequence[DataFrame], k: int = 20, rrf_k: int = 60, id_col: str = "doc_id", keys: Sequence[str] = ("query_id",),
) -> DataFrame:
    """Sum of 1 / (zero-based rank + rrf_k) over the lists."""
    rows = None
    for hits in lists:
        part = hits.select(*keys, id_col, (F.lit(1.0) / (F.col("rank") - 1 + rrf_k)).alias("part"))
        rows = part if rows is None else rows.unionByName(part)
    scored = rows.groupBy(*keys, id_col).agg(rounded(F.sum("part")).alias("score"))
    return best(scored, keys, k, id_col)


def fetch_sizes(k: int, bm25_k: int | None = None, vector_k: int | None = None) -> tuple[int, int]:
    """How many results each side contributes unless given: twice k up to 50, and never fewer than k."""
    default = max(k, min(2 * k, 50))
    return default if bm25_k is None else bm25_k, default if vector_k is None else vector_k


def compare_runs(first: DataFrame, second: DataFrame, id_col: str = "doc_id", keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """Two runs side by side: both ranks, the shift, and whether the result is in both. `keys` name a query, with its
    tenant if any."""
    a = first.select(*keys, id_col, F.col("rank").alias("rank_a"))
    b = second.select(*keys, id_col, F.col("rank").alias("rank_b"))
    return a.join(b, [*keys, id_col], "full_outer").withColumns(
        {
            "shift": F.col("rank_a") - F.col("rank_b"),
            "in_both": F.col("rank_a").isNotNull() & F.col("rank_b").isNotNull(),
        }
    )


def overlap_at_k(first: DataFrame, second: DataFrame, k: int, id_col: str = "doc_id", keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """Share of the first k results that both runs have, per query."""
    rows = compare_runs(first.where(F.col("rank") <= k), second.where(F.col("rank") <= k), id_col, keys)
    return rows.groupBy(*keys).agg(
        (F.count_if("in_both") / F.greatest(F.count("rank_a"), F.count("rank_b"), F.lit(1))).alias("overlap")
    )
