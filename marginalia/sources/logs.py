"""JSON log records with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

CALL_SCHEMA = "ts TIMESTAMP, component STRING, model STRING, prompt STRING, response STRING, seconds DOUBLE"
METRIC_SCHEMA = "ts TIMESTAMP, operation STRING, seconds DOUBLE, failed BOOLEAN, metadata MAP<STRING,STRING>"
STAGE_SCHEMA = "ts TIMESTAMP, persona_id STRING, query STRING, documents INT, timings MAP<STRING,DOUBLE>"
RERANK_SCHEMA = "ts TIMESTAMP, query STRING, candidates ARRAY<STRING>, scores ARRAY<DOUBLE>"
HYPOTHESIS_SCHEMA = "ts TIMESTAMP, query STRING, prompt STRING, response STRING"


def append_log(rows: DataFrame, path: str, ts: str = "ts") -> None:
    """Append records as JSON lines, a folder per day."""
    rows.withColumn("day", F.to_date(ts)).write.mode("append").partitionBy("day").json(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def stream_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def token_estimate(text: Column) -> Column:
    """White-space words stand in for tokens."""
    return T.count_words(text)


def with_token_counts(calls: DataFrame) -> DataFrame:
    p, r = token_estimate(F.col("prompt")), token_estimate(F.col("response"))
    return calls.withColumns({"prompt_tokens": p, "response_tokens": r, "total_tokens": p + r})


def cached_hypotheses(log: DataFrame) -> DataFrame:
    """Newest logged hypothesis per query."""
    return log.groupBy(F.md5("query").alias("query_hash")).agg(F.max_by("response", "ts").alias("hypothesis"), F.max("ts").alias("ts"))
