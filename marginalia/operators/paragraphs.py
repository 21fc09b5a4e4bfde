"""Paragraphs of a transcript by the similarity of neighbouring sentences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.arrays import cosine, posexplode_rows
from . import folds, ranking


def neighbour_similarity(sentences: DataFrame, *, id_col: str = "doc_id", pos: str = "pos", vec: str = "vec") -> DataFrame:
    """Cosine of each sentence to the next one of its document; null for the last."""
    following = F.lead(vec).over(Window.partitionBy(id_col).orderBy(pos))
    rows = sentences.withColumn("_next", following)
    return rows.withColumn("sim", F.when(F.col("_next").isNotNull(), ranking.rounded(cosine(F.col(vec), F.col("_next"))))).drop("_next")


def semantic_paragraphs(
    docs: DataFrame, embed: Callable[[Column], Column], *, id_col: str = "doc_id", content: str = "content",
    low: float = 0.5, high: float = 0.8, min_len: int = 3, max_len: int = 8,
) -> DataFrame:
    """(id, threshold, paragraphs, formatted). A break needs a similarity below the clamped tenth percentile
    and at least `min_len` sentences; `max_len` forces one. Up to three sentences stay together."""
    rows = posexplode_rows(docs.select(id_col, content), [id_col], T.sentences(F.col(content)), "pos", "sentence")
    rows = neighbour_similarity(rows.withColumn("vec", embed(F.col("sentence"))), id_col=id_col).drop("vec")
    item = F.struct("pos", "sentence", "sim")
    per_doc = rows.groupBy(id_col).agg(
        F.array_sort(F.collect_list(item)).alias("_s"), F.percentile("sim", 0.1).alias("_p"), F.count("*").alias("_n")
    )
    per_doc = per_doc.withColumn(
        "threshold", F.when(F.col("_p").isNotNull(), F.round(F.least(F.greatest("_p", F.lit(low)), F.lit(high)), 7))
    )
    flags = F.transform(F.slice("_s", F.lit(1), F.greatest(F.col("_n").cast("int") - 1, F.lit(0))), lambda x: x["sim"] < F.col("threshold"))
    per_doc = per_doc.withColumn("_flags", flags).withColumn("_runs", folds.paragraph_runs(F.col("_flags"), min_len, max_len))
    texts = F.transform("_s", lambda x: x["sentence"])
    per_doc = per_doc.withColumn("_t", texts)
    paragraphs = F.transform("_runs", lambda r: F.array_join(F.slice("_t", r["start"], r["len"]), " "))
    whole = F.col("_n") <= 3
    return per_doc.select(
        id_col, F.coalesce("threshold", F.lit(-1.0)).alias("threshold"),
        F.when(whole, F.lit(1)).otherwise(F.size("_runs")).alias("paragraphs"),
        F.when(whole, F.array_join("_t", " ")).otherwise(F.array_join(paragraphs, "\n\n")).alias("formatted"),
    )
