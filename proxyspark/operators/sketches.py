"""Latency sketches that merge: windows of any length without reading rows.

An hour's KLL sketch is a few hundred bytes however many rows it stands for. Exact
percentiles of a window need its rows, or all their values; sketches of its hours merge
into one whose ranks are right to about 1.5 per cent of the rows.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proxyspark.operators.scope import Scope, apply_scope

_OWNER = ["org_id", "user_id", "upload_id"]
FRACTIONS = {"latency_p50": 0.50, "latency_p95": 0.95, "latency_p99": 0.99}


def latency_sketches(entries: DataFrame) -> DataFrame:
    """One sketch of ``latency_ms`` per owner, upload and hour that has any."""
    timed = entries.where(F.col("ts").isNotNull() & F.col("latency_ms").isNotNull())
    return timed.groupBy(*_OWNER, F.date_trunc("hour", "ts").alias("bucket_start")).agg(
        F.kll_sketch_agg_bigint(F.col("latency_ms").cast("bigint")).alias("latency_sketch"))


def sketched_latency(sketches: DataFrame, scope: Scope, by: list[str]) -> DataFrame:
    """Observations and percentiles of a scope by some of a sketch's columns; the
    percentiles are values whose rank is about the one asked for."""
    merged = apply_scope(sketches, scope, "bucket_start").groupBy(*by).agg(F.kll_merge_agg_bigint("latency_sketch").alias("s"))
    return merged.select(*by, F.kll_sketch_get_n_bigint("s").alias("observations"), *[
        F.kll_sketch_get_quantile_bigint("s", F.lit(p)).alias(name) for name, p in FRACTIONS.items()])


def rank_errors(estimates: DataFrame, entries: DataFrame, scope: Scope, by: list[str]) -> DataFrame:
    """How far each estimate's rank is from the one asked for, as a share of the rows,
    measured against the rows themselves."""
    counts = apply_scope(entries, scope).where(F.col("latency_ms").isNotNull()).groupBy(*by, "latency_ms").agg(F.count(F.lit(1)).alias("n"))
    beside = counts.join(estimates, by)
    def share(keep):
        return F.sum(F.when(keep, F.col("n")).otherwise(0)) / F.sum("n")
    found = beside.groupBy(*by, "observations", *FRACTIONS).agg(*[
        F.greatest(share(F.col("latency_ms") < F.col(name)) - p, p - share(F.col("latency_ms") <= F.col(name)), F.lit(0.0)).alias(f"{name}_error")
        for name, p in FRACTIONS.items()])
    return found.select(*by, "observations", *[f"{name}_error" for name in FRACTIONS])
