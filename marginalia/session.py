"""Session defaults and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
MAX_ARROW_BYTES = str(8 << 20)


def small_batches(spark: SparkSession) -> SparkSession:
    """Python gets at most 8 MB at once (and one row more), so its memory does not follow the rows of a split."""
    spark.conf.set(ARROW_BYTES, MAX_ARROW_BYTES)
    return spark


def build_session(app: str = "marginalia", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution and UTC; a cluster's own settings win over these."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        ARROW_BYTES: MAX_ARROW_BYTES,
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: `spark.checkpoint.dir`. Where it is unset, a local session (as in tests) gets a
    temporary folder, and a cluster an error: its machines do not share one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(base)
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept_table(df: DataFrame, name: str) -> DataFrame:
    """`df` written once as a compressed table in the shared folder; for rows that are many and read again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bytes_of(column: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes; null counts as nothing."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(column)
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.NumericType, T.BooleanType)):
        size = F.size(column) * 8
    elif isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        size = F.octet_length(F.to_json(F.struct(column)))
    else:
        size = F.lit(8)
    return F.coalesce(size, F.lit(0)).cast("bigint") + 8


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000, max_bytes: int = 64 << 20) -> DataFrame:
    """Mark `df` for broadcast only after a bounded look shows at most `max_rows` rows of at most `max_bytes` in all.

    Larger inputs come back unmarked, so the join is shuffled and AQE splits skewed partitions.
    """
    sizes = [_bytes_of(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields]
    row = sum(sizes[1:], sizes[0]) if sizes else F.lit(0)
    seen = df.select(row.alias("bytes")).limit(max_rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if seen.n <= max_rows and seen.bytes <= max_bytes else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-spread an input that has fewer splits than the cluster has cores; others are left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


_SHIPPED: set[str] = set()


def ship_packages(spark: SparkSession, *folders: str) -> None:
    """Send the Python packages in `folders` to the executors once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    target = os.path.join(tempfile.mkdtemp(prefix="spark-"), "marginalia_packages.zip")
    with zipfile.ZipFile(target, "w") as out:
        for folder in folders:
            root = os.path.dirname(os.path.abspath(folder))
            for here, _, names in os.walk(folder):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(here, name)
                        out.write(path, os.path.relpath(os.path.abspath(path), root))
    spark.sparkContext.addPyFile(target)
