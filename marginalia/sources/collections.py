"""Collections as Parquet tables partitioned by tenant and knowledge type."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import broadcast_if_small

PARTITIONS = ["persona_id", "knowledge_type"]


def append(rows: DataFrame, path: str, *, quarantine: str | None = None, id_col: str = "chunk_id", content: str = "content") -> None:
    """Append good rows; rows without id or text go to the quarantine table."""
    good = F.col(id_col).isNotNull() & (F.coalesce(F.col(content), F.lit("")) != "")
    rows.where(good).write.mode("append").partitionBy(*PARTITIONS).parquet(path)
    if quarantine:
        rows.where(~good).withColumn("reason", F.when(F.col(id_col).isNull(), "missing id").otherwise("missing content")).write.mode(
            "append").partitionBy(*PARTITIONS).parquet(quarantine)


def read(spark: SparkSession, path: str, persona_id: str | None = None, knowledge_type: str | None = None) -> DataFrame:
    """Scan with partition pruning."""
    rows = spark.read.parquet(path)
    for column, value in (("persona_id", persona_id), ("knowledge_type", knowledge_type)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows


def merged(old: DataFrame, new: DataFrame, key: Sequence[str] = ("persona_id", "record_key")) -> DataFrame:
    """Old rows whose key is not in `new`, plus `new`: applying it twice changes nothing."""
    return old.join(new.select(*key), list(key), "left_anti").unionByName(new, allowMissingColumns=True)


def replace_partitions(rows: DataFrame, path: str) -> None:
    """Overwrite exactly the partitions present in `rows`."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(path)


def upsert(spark: SparkSession, new: DataFrame, path: str, staging: str, key: Sequence[str] = ("persona_id", "record_key")) -> None:
    """Merge into the touched partitions only. The merged rows are staged first, so no file is read while it is replaced.

    The swap of a partition is not atomic for its readers."""
    touched = broadcast_if_small(new.select(*PARTITIONS).distinct())
    old = spark.read.parquet(path).join(touched, PARTITIONS, "left_semi") if _exists(spark, path) else None
    result = new if old is None else merged(old, new, key)
    result.write.mode("overwrite").parquet(staging)
    replace_partitions(spark.read.parquet(staging), path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def without(rows: DataFrame, ids: DataFrame | None = None, id_col: str = "chunk_id", persona_id: str | None = None, knowledge_type: str | None = None) -> DataFrame:
    """Rows left after deleting ids, or a whole collection."""
    if ids is not None:
        return rows.join(ids.select(id_col), id_col, "left_anti")
    gone = F.lit(True)
    for column, value in (("persona_id", persona_id), ("knowledge_type", knowledge_type)):
        if value is not None:
            gone = gone & (F.col(column) == value)
    return rows.where(~gone)


def replace_all(rows: DataFrame, path: str, staging: str) -> None:
    """Make `rows` the whole content of the table at `path`, which they may be read from: staged first, then written over
    every partition, so partitions without rows vanish. Readers see neither an old nor a new table while it is swapped;
    a lost job leaves the staged copy."""
    rows.write.mode("overwrite").partitionBy(*PARTITIONS).parquet(staging)
    staged = rows.sparkSession.read.schema(rows.schema).parquet(staging)
    staged.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*PARTITIONS).parquet(path)


def delete(spark: SparkSession, path: str, staging: str, **what) -> None:
    """Delete rows from storage; `what` as in `without`."""
    replace_all(without(spark.read.parquet(path), **what), path, staging)


def clear(spark: SparkSession, path: str, staging: str) -> None:
    """Delete all rows of a stored table; its columns stay."""
    replace_all(spark.read.parquet(path).where(F.lit(False)), path, staging)


def migrate(shared: DataFrame, persona_id: str, source: str, when: Column, embed: Callable[[Column], Column], *, id_col: str = "chunk_id", vec: str = "embedding") -> DataFrame:
    """A shared collection as a tenant's: prefixed ids, provenance, stored vectors reused, missing ones computed."""
    missing = F.col(vec).isNull()
    return shared.withColumns({
        "persona_id": F.lit(persona_id), "migrated_from": F.lit(source), "migration_date": when,
        id_col: F.concat_ws("_", F.lit(persona_id), id_col),
        vec: F.coalesce(vec, embed(F.when(missing, F.col("content")))),
    })
