"""Versioned JSON artifacts of nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.telemetry import latest

NAME = r"persona_(.+)_(\d{8}_\d{6})\.json(\.gz)?$"


def parse_names(files: DataFrame, name: str = "file_name") -> DataFrame:
    """Tenant, time and compression from the file name; other names are dropped."""
    rows = files.withColumns({
        "persona_id": F.regexp_extract(name, NAME, 1),
        "created_at": F.try_to_timestamp(F.regexp_extract(name, NAME, 2), F.lit("yyyyMMdd_HHmmss")),
        "compressed": F.endswith(name, F.lit(".gz")),
    })
    return rows.where((F.col("persona_id") != "") & F.col("created_at").isNotNull())


def well_formed(artifacts: DataFrame, json: str = "json") -> DataFrame:
    """Artifacts that parse to an object and whose knowledge keys, if present, are arrays."""
    v = F.try_parse_json(F.col(json))
    ok = F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))
    for key in ("mental_models", "core_beliefs"):
        field = F.try_variant_get(v, f"$.{key}", "variant")
        ok = ok & (field.isNull() | F.startswith(F.schema_of_variant(field), F.lit("ARRAY")))
    return artifacts.where(F.coalesce(ok, F.lit(False)))


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Well-formed artifacts under a folder, gzip included: persona_id, created_at, file_name, file_size, compressed, json."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(
        F.col("value").alias("json"), F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_size").alias("file_size")
    )
    return well_formed(parse_names(raw))


def latest_artifacts(artifacts: DataFrame) -> DataFrame:
    return latest(artifacts, ["persona_id"], "created_at", "file_name")


def write_versions(records: DataFrame, path: str, *, version: str, compress: bool = True) -> None:
    """Append one version per tenant as JSON lines, by tenant and version."""
    out = records.withColumn("version", F.lit(version)).write.mode("append").partitionBy("persona_id", "version")
    (out.option("compression", "gzip") if compress else out).json(path)


def read_versions(spark: SparkSession, path: str, schema=None, version: str | None = None) -> DataFrame:
    """A named version, or the latest per tenant."""
    rows = (spark.read.schema(schema) if schema is not None else spark.read).json(path)
    rows = rows.withColumn("version", F.col("version").cast("string"))
    return rows.where(F.col("version") == version) if version else latest(rows, ["persona_id"], "version")


def export_json(records: DataFrame, fmt: str = "json") -> DataFrame:
    """One JSON text per record."""
    if fmt != "json":
        raise ValueError(f"Unsupported export format: {fmt}")
    return records.select(F.to_json(F.struct(*records.columns)).alias("value"))
