"""First-copy de-duplication and the checks that report copies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def fingerprint(content: Column, chars: int | None = None) -> Column:
    """Hash of a lower-cased, stripped text, or of its first `chars` characters."""
    return F.sha2(F.lower(T.strip(content if chars is None else F.left(content, F.lit(chars)))), 256)


def first_per_fingerprint(
    docs: DataFrame, *, order: Sequence[str] = ("source",), keys: Sequence[str] = (), content: str = "content", chars: int | None = None,
) -> DataFrame:
    """Keep the first document of every fingerprint; documents without text are dropped.

    The whole text counts; `chars=200` compares starts only and so drops longer documents that differ later.

    The group limit runs before the shuffle too, so a fingerprint shared by a third of all documents
    sends one row per task.
    """
    rows = docs.where(F.col(content).rlike(rf"[^{T.BLANK}]")).withColumn("_fp", fingerprint(F.col(content), chars))
    w = Window.partitionBy(*keys, "_fp").orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n", "_fp")


def new_documents(
    incoming: DataFrame, existing: DataFrame | None, *, order: Sequence[str] = ("source",),
    keys: Sequence[str] = (), content: str = "content",
) -> DataFrame:
    """Incoming documents whose fingerprint is new, also against the stored ones when given.

    A stored `fingerprint` column is used as it is, so old texts are not read again."""
    fresh = first_per_fingerprint(incoming, order=order, keys=keys, content=content)
    if existing is None:
        return fresh
    stored = F.col("fingerprint") if "fingerprint" in existing.columns else fingerprint(F.col(content))
    seen = existing.select(*keys, stored.alias("_fp")).distinct()
    return fresh.withColumn("_fp", fingerprint(F.col(content))).join(seen, [*keys, "_fp"], "left_anti").drop("_fp")


def repeated_starts(docs: DataFrame, id_col: str = "doc_id", content: str = "content", chars: int = 100) -> DataFrame:
    """Documents whose first characters an earlier document already has.

    Counted by an aggregation with map-side combine and joined back only for the repeated starts.
    """
    rows = docs.select(id_col, F.md5(F.left(F.coalesce(F.col(content), F.lit("")), F.lit(chars))).alias("_start"))
    firsts = rows.groupBy("_start").agg(F.min(id_col).alias("first_id"), F.count("*").alias("copies")).where(F.col("copies") > 1)
    return rows.join(firsts, "_start").where(F.col(id_col) != F.col("first_id")).select(id_col, "first_id", "copies")
