"""Metrics and alerts over a long table of measurements.

``metric_events`` has ts, seq, name, type, labels (a map) and value.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proxyspark import fixed
from proxyspark.operators.order_stats import percentiles
from proxyspark.operators.scope import Scope, apply_scope

_PERCENTILES = {"p50": 0.50, "p95": 0.95, "p99": 0.99}


def label_key(labels: Column) -> Column:
    """Labels as text, independent of their order."""
    pairs = F.array_sort(F.map_entries(labels))
    return F.array_join(F.transform(pairs, lambda p: F.concat(p["key"], F.lit("="), p["value"])), ",")


def stage_percentiles(timings: DataFrame, scope: Scope | None = None) -> DataFrame:
    """Count and percentiles of processing time per stage."""
    rows = apply_scope(timings, scope, "created_at") if scope is not None else timings
    counts = rows.groupBy("stage").agg(F.count(F.lit(1)).alias("count"))
    found = percentiles(rows, ["stage"], "duration_ms", {f"{k}_ms": p for k, p in _PERCENTILES.items()})
    return counts.join(found, "stage", "left").orderBy("stage")


def metric_counters(events: DataFrame) -> DataFrame:
    """Per counter and label set: value; ``labels`` NULL is the counter's total."""
    series = events.where(F.col("type") == "counter").groupBy("name", label_key(F.col("labels")).alias("labels")).agg(
        F.sum("value").alias("raw"))
    totals = series.groupBy("name").agg(F.sum("raw").alias("raw")).withColumn("labels", F.lit(None).cast("string"))
    return series.unionByName(totals).select("name", "labels", F.bround("raw", 3).alias("value"))


def _ring(events: DataFrame, ring: int) -> DataFrame:
    """The latest samples of each histogram series."""
    order = Window.partitionBy("name", "series").orderBy(F.desc("ts"), F.desc("seq"))
    return (
        events.where(F.col("type") == "histogram")
        .select("name", label_key(F.col("labels")).alias("series"), "ts", "seq", "value")
        .withColumn("_age", F.row_number().over(order)).where(F.col("_age") <= ring).drop("_age")
    )


def _nearest_rank(samples: DataFrame, by: list[str]) -> DataFrame:
    """Percentiles at the rounded rank (half to even), at least 1."""
    keys = [F.col(k) for k in by]
    order = Window.partitionBy(*keys).orderBy("value")
    ranked = samples.withColumn("_rank", F.row_number().over(order)).withColumn(
        "_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    at = lambda p: F.least(F.greatest(F.rint(F.lit(p) * F.col("_n")), F.lit(1.0)), F.col("_n"))
    return ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"), F.min("value").alias("min"),
        *[F.max(F.when(F.col("_rank") == at(p), F.col("value"))).alias(k) for k, p in _PERCENTILES.items()],
        F.max("value").alias("max"), F.avg("value").alias("mean"),
    )


def metric_histograms(events: DataFrame, ring: int = fixed.HISTOGRAM_RING) -> DataFrame:
    """Per histogram series over its latest samples, to three decimals."""
    out = _nearest_rank(_ring(events, ring), ["name", "series"])
    return out.select(
        "name", F.col("series").alias("labels"), "count",
        *[F.bround(c, 3).alias(c) for c in ("min", *_PERCENTILES, "max", "mean")])


def metric_gauges(events: DataFrame) -> DataFrame:
    """Last reading per gauge, plus any later increments (type gauge_delta)."""
    mine = events.where(F.col("type").isin("gauge", "gauge_delta"))
    is_set = F.col("type") == "gauge"
    when = F.struct("ts", "seq")
    last = mine.groupBy("name").agg(
        F.max_by("value", F.when(is_set, when)).alias("_set"), F.max(F.when(is_set, when)).alias("_at"))
    later = mine.where(~is_set).join(last, "name").where(
        F.col("_at").isNull() | (F.struct("ts", "seq") > F.col("_at"))
    ).groupBy("name").agg(F.sum("value").alias("_delta"))
    value = F.coalesce("_set", F.lit(0.0)) + F.coalesce("_delta", F.lit(0.0))
    return last.join(later, "name", "left").select("name", F.bround(value, 3).alias("value"))


def _ratio_sums(events: DataFrame, by: list[str]) -> DataFrame:
    total = lambda name, outcome=None: F.coalesce(F.sum(F.when(
        (F.col("name") == name) & (F.col("type") == "counter")
        & (F.lit(True) if outcome is None else F.coalesce(F.col("labels")["outcome"] == outcome, F.lit(False))),
        F.col("value"))), F.lit(0.0))
    return events.groupBy(*by).agg(
        total("http.requests").alias("requests"), total("http.errors").alias("errors"),
        total("analyses.total").alias("analyses"), total("analyses.total", "done").alias("analyses_ok"),
        total("llm.calls").alias("calls"), total("llm.calls", "ok").alias("calls_ok"))


def derived_ratios(events: DataFrame, by: list[str] = ()) -> DataFrame:
    """Success, error and fallback ratios; NULL without a denominator."""
    ratio = lambda a, b: F.bround(F.try_divide(a, b), 4)
    c = F.col
    return _ratio_sums(events, list(by)).select(
        *by, ratio(c("requests") - c("errors"), c("requests")).alias("http_success_rate"),
        ratio(c("errors"), c("requests")).alias("http_error_rate"),
        ratio(c("analyses_ok"), c("analyses")).alias("analysis_success_rate"),
        ratio(c("calls_ok"), c("calls")).alias("llm_success_rate"),
        ratio(c("calls") - c("calls_ok"), c("calls")).alias("llm_fallback_rate"))


def evaluate_alerts(events: DataFrame, thresholds: dict | None = None, window: str = "60 seconds",
                    ring: int = fixed.HISTOGRAM_RING) -> DataFrame:
    """Threshold checks per window: (window_start, alert, value, breached).

    Windows with too few samples are not judged. Feed the result to
    ``alert_changes`` for firing and resolved transitions.
    """
    limit = {**fixed.ALERT_THRESHOLDS, **(thresholds or {})}
    timed = events.withColumn("window_start", F.window("ts", window).start)
    latency = timed.where((F.col("name") == "http.latency_ms") & (F.col("type") == "histogram"))
    order = Window.partitionBy("window_start", "series").orderBy(F.desc("ts"), F.desc("seq"))
    held = latency.withColumn("series", label_key(F.col("labels"))).withColumn(
        "_age", F.row_number().over(order)).where(F.col("_age") <= ring)
    p95 = _nearest_rank(held, ["window_start"]).where(F.col("count") >= fixed.MIN_ALERT_SAMPLES).select(
        "window_start", F.lit("http_latency_p95").alias("alert"), F.col("p95").alias("value"))
    sums = _ratio_sums(timed, ["window_start"])
    errors = sums.where(F.col("requests") >= fixed.MIN_ALERT_SAMPLES).select(
        "window_start", F.lit("http_error_rate").alias("alert"), (F.col("errors") / F.col("requests")).alias("value"))
    fallback = sums.where(F.col("calls") >= fixed.MIN_ALERT_CALLS).select(
        "window_start", F.lit("llm_fallback_rate").alias("alert"),
        F.bround((F.col("calls") - F.col("calls_ok")) / F.col("calls"), 4).alias("value"))
    cpu = timed.where(F.col("name") == "process.cpu_percent").groupBy("window_start").agg(
        F.max_by("value", F.struct("ts", "seq")).alias("value")).where(F.col("value") > 0).select(
        "window_start", F.lit("cpu_high").alias("alert"), "value")
    checks = reduce(DataFrame.unionByName, [p95, errors, fallback, cpu])
    bound = reduce(lambda acc, kv: acc.when(F.col("alert") == kv[0], F.lit(float(kv[1]))), list(limit.items())[1:],
                   F.when(F.col("alert") == list(limit)[0], F.lit(float(list(limit.values())[0]))))
    return checks.withColumn("threshold", bound).withColumn("breached", F.col("value") > F.col("threshold"))


def alert_changes(checks: DataFrame) -> DataFrame:
    """Only firing and resolved transitions per alert, in time order.

    At most one row per alert and window reaches this ordering.
    """
    order = Window.partitionBy("alert").orderBy("window_start")
    before = F.coalesce(F.lag("breached").over(order), F.lit(False))
    return checks.withColumn("_before", before).where(F.col("breached") != F.col("_before")).select(
        "window_start", "alert", F.when(F.col("breached"), "firing").otherwise("resolved").alias("state"), "value")
