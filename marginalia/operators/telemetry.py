"""Results kept by content hash, and measurements of runs, caches and jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranking
from .assembly import running_total

RESULT_KEYS = ["content_hash", "kind", "settings_hash"]


def result_rows(results: DataFrame, *, kind: Column, settings_hash: Column, now: Column, version: str = "1") -> DataFrame:
    """Rows of the results table, from (content_hash, payload, items)."""
    return results.select(
        "content_hash", kind.alias("kind"), settings_hash.alias("settings_hash"), "payload", "items",
        F.lit(version).alias("version"), now.alias("saved_at"),
    )


def fresh_results(results: DataFrame, now: Column, max_age_hours: float | None = 24.0) -> DataFrame:
    """Results young enough to be used; the newest per key."""
    if max_age_hours is not None:
        results = results.where(F.col("saved_at") >= now - F.make_interval(secs=F.lit(max_age_hours * 3600.0).cast("decimal(18,6)")))
    return ranking.top_k(results, RESULT_KEYS, [F.desc("saved_at")], 1, "_n").drop("_n")


def reuse(work: DataFrame, results: DataFrame, now: Column, max_age_hours: float | None = 24.0) -> tuple[DataFrame, DataFrame]:
    """(work with a usable result, work still to do). Work carries content_hash, kind, settings_hash."""
    valid = fresh_results(results, now, max_age_hours)
    return work.join(valid.select(*RESULT_KEYS, "payload"), RESULT_KEYS), work.join(valid.select(*RESULT_KEYS), RESULT_KEYS, "left_anti")


def keep_young(rows: DataFrame, now: Column, ts: str = "saved_at", hours: int = 168) -> DataFrame:
    """Rows within their age limit; the clock is an argument."""
    return rows.where(F.col(ts) >= now - F.make_interval(hours=F.lit(hours)))


def expire_jobs(jobs: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Jobs that are not finished, or finished less than `hours` ago."""
    done = F.col("status").isin("completed", "failed")
    return jobs.where(~done | (F.col("updated_at") >= now - F.make_interval(hours=F.lit(hours))))


def cache_statistics(lookups: DataFrame, by: Sequence[str] = ("kind",)) -> DataFrame:
    """Hits, misses and hit rate per kind; `lookups` has a boolean `hit`."""
    agg = lookups.groupBy(*by).agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    return agg.withColumn("hit_rate", F.coalesce(F.try_divide(F.col("hits"), F.col("hits") + F.col("misses")), F.lit(0.0)))


def overall_hit_rate(stats: DataFrame) -> DataFrame:
    """Totals and the mean of the non-zero rates."""
    return stats.agg(
        F.sum("hits").alias("hits"), F.sum("misses").alias("misses"),
        F.coalesce(F.avg(F.nullif(F.col("hit_rate"), F.lit(0.0))), F.lit(0.0)).alias("mean_hit_rate"),
    )


def batch_statistics(log: DataFrame, by: Sequence[str] = ("kind",)) -> DataFrame:
    """Completion, cache and failure rates and the mean time of finished batches."""
    n = F.count("*")
    state = F.col("state")
    return log.groupBy(*by).agg(
        n.alias("batches"),
        F.try_divide(F.count_if(state.isin("completed", "cached")), n).alias("completion_rate"),
        F.try_divide(F.count_if(state == "cached"), n).alias("cache_rate"),
        F.try_divide(F.count_if(state == "failed"), n).alias("failure_rate"),
        F.avg(F.when(state == "completed", F.col("seconds"))).alias("mean_seconds"),
    )


def resume_state(log: DataFrame, total: DataFrame, by: Sequence[str] = ("kind",)) -> DataFrame:
    """Finished of all batches per kind; `total` has (kind, total_batches)."""
    done = log.where(F.col("state").isin("completed", "cached")).groupBy(*by).agg(F.count_distinct("batch").alias("done"))
    return total.join(done, list(by), "left").withColumn("done", F.coalesce("done", F.lit(0))).withColumn(
        "remaining", F.col("total_batches") - F.col("done")
    )


def latest(rows: DataFrame, keys: Sequence[str], ts: str, tie: str | None = None) -> DataFrame:
    """Newest row per key."""
    order = [F.desc(ts)] + ([F.desc(tie)] if tie else [])
    return ranking.top_k(rows, list(keys), order, 1, "_n").drop("_n")


def job_overview(updates: DataFrame, *, job: str = "job_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Jobs per current status. The newest update wins."""
    current = updates.groupBy(job).agg(F.max_by("status", F.struct(ts, tie)).alias("status"))
    return current.groupBy("status").agg(F.count("*").alias("jobs"))


def daily_timings(rows: DataFrame, *, ts: str = "ts", operation: str = "operation", seconds: str = "seconds") -> DataFrame:
    return rows.groupBy(F.to_date(ts).alias("day"), operation).agg(
        F.count("*").alias("runs"), F.sum(seconds).alias("total_seconds"), F.min(seconds).alias("min_seconds"), F.max(seconds).alias("max_seconds")
    )


def timing_sketches(rows: DataFrame, *, ts: str = "ts", operation: str = "operation", seconds: str = "seconds", k: int = 400) -> DataFrame:
    """(day, operation, runs, sketch): a KLL sketch of the times, a binary column of bounded size.

    Tables of sketches are kept instead of rows: `merged_sketches` adds them up to weeks, months or tenants, and
    days that arrive later are appended. Null times count nowhere. A larger `k` gives closer quantiles.
    """
    known = rows.where(F.col(seconds).isNotNull())
    return known.groupBy(F.to_date(ts).alias("day"), operation).agg(
        F.count("*").alias("runs"), F.kll_sketch_agg_double(F.col(seconds).cast("double"), F.lit(k)).alias("sketch")
    )


def merged_sketches(sketches: DataFrame, by: Sequence[str | Column], k: int = 400) -> DataFrame:
    """One sketch per group of stored sketches: (by, runs, sketch)."""
    return sketches.groupBy(*by).agg(F.sum("runs").alias("runs"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))


def sketched_quantiles(sketches: DataFrame, quantiles: dict[str, float]) -> DataFrame:
    """`sketches` without the sketch and with one column per named quantile (0 and 1 are exact)."""
    return sketches.withColumns({name: F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))) for name, q in quantiles.items()}).drop("sketch")


def recent_mean(runs: DataFrame, keys: Sequence[str], stages: Sequence[str], n: int = 100, ts: str = "ts", tie: str = "run_id") -> DataFrame:
    """Mean stage times over the newest `n` runs; a missing stage counts as 0."""
    last = ranking.top_k(runs, list(keys), [F.desc(ts), F.desc(tie)], n, "_n")
    return last.groupBy(*keys).agg(F.count("*").alias("runs"), *[F.avg(F.coalesce(F.col(s), F.lit(0.0))).alias(f"{s}_mean") for s in stages])


def running_latency(queries: DataFrame, scope: Sequence[str], order: Sequence[str], *, latency: str = "latency_ms", hit: str = "cache_hit") -> DataFrame:
    """Mean latency and hit rate up to and including each query."""
    values = {"_n0": F.lit(1), "_l0": F.col(latency), "_h0": F.col(hit).cast("int")}
    rows = running_total(queries, scope, order, values)
    n = F.col("_n0") + 1
    return rows.withColumns({
        "queries": n, "mean_latency": (F.col("_l0") + F.col(latency)) / n,
        "hit_rate": (F.col("_h0") + F.col(hit).cast("int")) / n,
    }).drop(*values)
