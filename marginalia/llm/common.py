"""Pieces that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.session import scratch_path

#: ASCII white space, the only white space of the operators on lines, words and copies.
SPACE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables. Arrow batches stay small, because some texts are very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends, lost executors cost nothing done before."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def utf8(col: str | Column) -> Column:
    """Text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("binary")


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo `n`: the fold of a document."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def without(df: DataFrame, *names: str) -> DataFrame:
    """`df` without columns that an operator adds itself: the operator's columns win."""
    lower = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in lower])


def schema_of(df: DataFrame | None, **added: str | T.DataType) -> T.StructType:
    """Schema of `df` and further columns given as name=type."""
    out = T.StructType(list(df.schema.fields) if df is not None else [])
    for name, kind in added.items():
        out = out.add(name, kind if isinstance(kind, T.DataType) else T.DataType.fromDDL(kind))
    return out


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no part holds more than about `max_bytes` of one column, and no part is empty."""
    sizes = [len(x) if x is not None else 0 for x in batch.column(column).to_pylist()]
    start = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > max_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)
