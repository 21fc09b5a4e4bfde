"""Re-ranking of candidate lists by a pair score, optionally weighted by confidence."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranking
from .models import term_overlap


def rerank(
    candidates: DataFrame, k: int = 5, *, query: str = "query", text: str = "content", id_col: str = "doc_id",
    score_pairs: Callable[[Column, Column], Column] = term_overlap, keys: Sequence[str] = ("query_id",),
) -> DataFrame:
    """Score (query, text) pairs and keep the best `k` per query; `keys` name a query, with its tenant if any.

    Candidates carry query_id, the query, the text and their incoming rank; that rank decides between
    equal scores, so a scorer that failed (all 1.0) leaves the order as it was.
    """
    scored = candidates.withColumnRenamed("rank", "_rank_in").withColumn(
        "score", ranking.rounded(F.coalesce(score_pairs(F.col(query), F.col(text)), F.lit(1.0)))
    )
    out = ranking.top_k(scored, keys, [F.desc("score"), F.asc("_rank_in"), F.asc(id_col)], k)
    return out.drop("_rank_in")


def weight_by_confidence(
    hits: DataFrame, confidence: str = "confidence_score", *, score_weight: float = 0.6, id_col: str = "doc_id",
    keys: Sequence[str] = ("query_id",),
) -> DataFrame:
    """Blend score and confidence (0.5 where missing) and order the survivors anew; `keys` as in `rerank`."""
    blend = F.col("score") * score_weight + F.coalesce(F.col(confidence), F.lit(0.5)) * (1 - score_weight)
    scored = hits.drop("rank").withColumn("score", ranking.rounded(blend))
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc(id_col))
    return scored.withColumn("rank", F.row_number().over(w))
