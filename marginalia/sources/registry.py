"""Tenant registry as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def register(registry: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Insert tenants (name, language) that are not there yet; existing ones stay as they are.

    Of several names with one id the smallest is taken."""
    rows = new.groupBy(T.persona_id(F.col("name")).alias("persona_id")).agg(F.min(F.struct("name", "language")).alias("_r")).select("persona_id", "_r.name", "_r.language")
    rows = rows.join(registry.select("persona_id"), "persona_id", "left_anti")
    rows = rows.withColumns({"created_at": now, "updated_at": now, "documents": F.lit(0).cast("bigint"), "words": F.lit(0).cast("bigint")})
    return registry.unionByName(rows.select(*registry.columns))


def update_stats(registry: DataFrame, stats: DataFrame, now: Column) -> DataFrame:
    """Patch document and word counts of the tenants in `stats`."""
    patch = stats.select("persona_id", F.col("documents").alias("_d"), F.col("words").alias("_w"), F.lit(True).alias("_hit"))
    rows = registry.join(patch, "persona_id", "left").withColumns({
        "documents": F.coalesce("_d", "documents"), "words": F.coalesce("_w", "words"),
        "updated_at": F.when(F.col("_hit"), now).otherwise(F.col("updated_at")),
    })
    return rows.select(*registry.columns)


def remove(registry: DataFrame, persona_ids: DataFrame) -> DataFrame:
    return registry.join(persona_ids.select("persona_id"), "persona_id", "left_anti")


def language_of(registry: DataFrame, persona_id: str) -> DataFrame:
    return registry.where(F.col("persona_id") == persona_id).select(F.coalesce("language", F.lit("en")).alias("language"))
