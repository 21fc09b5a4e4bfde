"""Telemetry and ingestion as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.dedup import fingerprint, new_documents

STATUS_ORDER = {"uploaded": 0, "queued": 1, "processing": 2, "completed": 3, "failed": 3}


def daily_timing_stream(rows: DataFrame, *, ts: str = "ts", operation: str = "operation", seconds: str = "seconds", late: str = "1 hour") -> DataFrame:
    """Runs and times per day and operation; rows later than `late` are dropped by the watermark."""
    return rows.withWatermark(ts, late).groupBy(F.window(ts, "1 day"), operation).agg(
        F.count("*").alias("runs"), F.sum(seconds).alias("total_seconds"), F.min(seconds).alias("min_seconds"),
        F.max(seconds).alias("max_seconds"), F.percentile_approx(seconds, 0.5).alias("median_seconds"),
    ).select(F.to_date("window.start").alias("day"), operation, "runs", "total_seconds", "min_seconds", "max_seconds", "median_seconds")


def distinct_updates(updates: DataFrame, *, id_col: str = "event_id", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each update once, as long as its copies arrive within the watermark."""
    return updates.withWatermark(ts, late).dropDuplicatesWithinWatermark([id_col])


class JobLifecycle(StatefulProcessor):
    """Newest state and counters per job; an update older than what earlier batches brought is counted as late.

    A job without updates for `hours` of processing time is forgotten (None keeps all jobs).
    """

    FIELDS = "ts TIMESTAMP, event_id BIGINT, status STRING, updates BIGINT, failures BIGINT, late BIGINT"
    OUTPUT = S.StructType([
        S.StructField("job_id", S.LongType()), S.StructField("ts", S.TimestampType()), S.StructField("status", S.StringType()),
        S.StructField("updates", S.LongType()), S.StructField("failures", S.LongType()), S.StructField("late", S.LongType()),
    ])

    def __init__(self, hours: float | None = 24.0) -> None:
        self.hours = hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("job", self.FIELDS, None if self.hours is None else int(self.hours * 3_600_000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.state.get() if self.state.exists() else None
        ts, event_id, status, updates, failures, late = known or (None, None, None, 0, 0, 0)
        before = None if ts is None else (pd.Timestamp(ts.replace(tzinfo=None)), event_id)
        for frame in rows:
            updates += len(frame)
            if before is not None:
                late += int(((frame["ts"] < before[0]) | ((frame["ts"] == before[0]) & (frame["event_id"] < before[1]))).sum())
            failures += int((frame["status"] == "failed").sum())
            top = frame.sort_values(["ts", "event_id"]).iloc[-1]
            at = (top["ts"].to_pydatetime(), int(top["event_id"]))
            if ts is None or at > (ts.replace(tzinfo=None), event_id):
                ts, event_id, status = at[0], at[1], top["status"]
        self.state.update((ts, event_id, status, updates, failures, late))
        yield pd.DataFrame({"job_id": [key[0]], "ts": [pd.Timestamp(ts).tz_localize(None)], "status": [status], "updates": [updates], "failures": [failures], "late": [late]})

    def close(self) -> None:
        pass


def job_stream(updates: DataFrame, *, mode: str = "update", hours: float | None = 24.0) -> DataFrame:
    """Job states by key, kept `hours` after their last update (such a stream wakes up by itself and so has no end; a
    run over given files takes None); needs the RocksDB state store (`spark.sql.streaming.stateStore.providerClass`)."""
    return updates.select("job_id", "ts", "event_id", "status").groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=JobLifecycle(hours), outputStructType=JobLifecycle.OUTPUT, outputMode=mode,
        timeMode="None" if hours is None else "ProcessingTime",
    )


def ingest_batch(path: str, *, order: list[str], keys: list[str]):
    """`foreachBatch` function: append the documents whose fingerprint the table does not hold yet."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
        existing = spark.read.parquet(path).where(F.col("_batch") != batch_id) if there else None
        fresh = new_documents(batch, existing, order=order, keys=keys).withColumns({"_batch": F.lit(batch_id).cast("bigint"), "fingerprint": fingerprint(F.col("content"))})
        # A batch that is run again replaces its own partition.
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_batch").parquet(path)

    return run
