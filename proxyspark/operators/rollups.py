"""Time-bucket rollups over canonical log entries."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proxyspark import fixed
from proxyspark.functions import labels
from proxyspark.operators.order_stats import counted_percentiles, percentiles_of_counts, value_counts

_OWNER = ["org_id", "user_id", "upload_id"]
_LATENCY = {"latency_p50": 0.50, "latency_p95": 0.95, "latency_p99": 0.99}
_SUMS = ["requests", "bytes_in", "bytes_out", "errors", "cache_hits", "cache_total"]


def _cells(entries: DataFrame) -> DataFrame:
    """Minute cells split by latency value: sums plus an exact value histogram.

    Grouping by the latency value as well keeps every aggregate a plain sum
    that combines map-side, so one busy host cannot pile up in one task.
    """
    return (
        entries.where(F.col("ts").isNotNull())
        .select(
            *_OWNER, F.coalesce("host", F.lit("")).alias("host"),
            F.date_trunc("minute", "ts").alias("bucket_start"), "latency_ms",
            "resp_bytes", "req_bytes", "resp_code", "cache_status",
        )
        .groupBy(*_OWNER, "host", "bucket_start", "latency_ms")
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.coalesce(F.sum("resp_bytes"), F.lit(0)).alias("bytes_in"),
            F.coalesce(F.sum("req_bytes"), F.lit(0)).alias("bytes_out"),
            F.count_if(labels.is_error(F.col("resp_code"))).alias("errors"),
            F.count_if(labels.is_cache_hit(F.col("cache_status"))).alias("cache_hits"),
            F.count("cache_status").alias("cache_total"),
        )
    )


def entry_rollups(entries: DataFrame, grain: str) -> DataFrame:
    """Traffic per (owner, upload, host, minute or hour) with exact percentiles."""
    if grain not in fixed.GRAINS:
        raise ValueError(f"unknown grain {grain!r}")
    return rollups_of_cells(_cells(entries), grain)


def rollups_of_cells(cells: DataFrame, grain: str) -> DataFrame:
    """Rollups of minute cells split by latency value; cells of one key and value may
    be spread over several rows, as different batches brought them."""
    if grain == "hour":
        cells = (
            cells.withColumn("bucket_start", F.date_trunc("hour", "bucket_start"))
            .groupBy(*_OWNER, "host", "bucket_start", "latency_ms")
            .agg(*[F.sum(c).alias(c) for c in _SUMS])
        )
    keys = [*_OWNER, "host", "bucket_start"]
    extra = [F.sum(c).alias(c) for c in _SUMS] + [F.sum("_w").alias("latency_count")]
    out = percentiles_of_counts(cells, keys, "latency_ms", _LATENCY, "requests", extra)
    return out.select(
        *_OWNER, "host", F.lit(grain).alias("grain"), "bucket_start", *_SUMS, *_LATENCY, "latency_count",
    )


def all_rollups(entries: DataFrame) -> DataFrame:
    """Both grains in one table."""
    return entry_rollups(entries, "minute").unionByName(entry_rollups(entries, "hour"))


def status_rollups(entries: DataFrame) -> DataFrame:
    """Per hour and response code: requests, one reason for display, p95."""
    keys = [*_OWNER, "bucket_start", "resp_code"]
    cells = (
        entries.where(F.col("ts").isNotNull() & F.col("resp_code").isNotNull())
        .select(*_OWNER, F.date_trunc("hour", "ts").alias("bucket_start"), "resp_code", "latency_ms", "reason")
        # The reason is a key here, so this pass is counters only.
        .groupBy(*keys, "latency_ms", "reason").agg(F.count(F.lit(1)).alias("requests"))
    )
    extra = [F.min("reason").alias("reason"), F.sum("requests").alias("requests")]
    out = percentiles_of_counts(cells, keys, "latency_ms", {"latency_p95": 0.95}, "requests", extra)
    return out.select(*keys, "reason", "requests", "latency_p95")


def org_baseline(rollups: DataFrame, org_id: str, window_days: int, exclude_upload, now) -> DataFrame:
    """Organization-wide context for one run measured against history.

    Hour rollups only, never log rows. One row: sums, hosts and the discrete
    median of hourly rows in the window, without the upload under analysis.
    """
    since = F.lit(str(now)).cast("timestamp") - F.make_dt_interval(F.lit(window_days))
    hours = rollups.where(
        (F.col("org_id") == F.lit(org_id)) & (F.col("grain") == "hour")
        & (F.col("bucket_start") >= since) & (F.col("upload_id") != F.lit(exclude_upload))
    )
    sums = hours.agg(
        F.sum("requests").alias("requests"), F.sum("errors").alias("errors"),
        F.count_distinct("host").alias("hosts"),
    )
    middle = counted_percentiles(value_counts(hours, [], "requests"), [], "requests", {"median": 0.5})
    one = sums.unionByName(middle, allowMissingColumns=True).agg(
        *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("requests", "errors", "hosts")],
        F.coalesce(F.max("median").cast("double"), F.lit(0.0)).alias("median_hourly_requests"),
    )
    return one.select(F.lit(window_days).alias("window_days"), "*")


def timeline(entries: DataFrame, by: list[str], minutes: int = fixed.TIMELINE_MINUTES) -> DataFrame:
    """Entries per fixed bucket of so many minutes."""
    bucket = F.window("ts", f"{minutes} minutes").start
    return (
        entries.where(F.col("ts").isNotNull())
        .groupBy(*by, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("total"))
    )
