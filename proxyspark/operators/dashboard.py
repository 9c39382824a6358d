"""Dashboard questions over rollups, entries and findings."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proxyspark import fixed
from proxyspark.functions import labels
from proxyspark.operators.order_stats import counted_percentiles, percentiles_of_counts, value_counts
from proxyspark.operators.scope import Scope, apply_scope, apply_tenancy, clamp
from proxyspark.session import pin

_LATENCY = {"latency_p50": 0.50, "latency_p95": 0.95, "latency_p99": 0.99}
_SUMS = ["requests", "errors", "bytes_in", "bytes_out", "cache_hits", "cache_total"]


def _rate(part, whole):
    return F.when(whole > 0, part / whole)


def dashboard_summary(rollups: DataFrame, entries: DataFrame, uploads: DataFrame, scope: Scope) -> DataFrame:
    """One row of headline figures.

    Sums come from hour rollups; percentiles from the rows, because bucket
    percentiles cannot be merged. Each part is one row, and the parts are
    folded together by a final one-row aggregate instead of a join.
    """
    sums = apply_scope(rollups.where(F.col("grain") == "hour"), scope, "bucket_start").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _SUMS], F.count_distinct("host").alias("hosts"),
    )
    counts = value_counts(apply_scope(entries, scope), [], "latency_ms")
    latency = counted_percentiles(counts, [], "latency_ms", _LATENCY)
    files = apply_scope(uploads, scope, "created_at").agg(F.count(F.lit(1)).alias("uploads"))
    span = apply_tenancy(rollups, scope).agg(
        F.min("bucket_start").alias("data_start"), F.max("bucket_start").alias("data_end"),
    )
    parts = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [sums, latency, files, span])
    names = [*_SUMS, "hosts", *_LATENCY, "uploads", "data_start", "data_end"]
    one = parts.agg(*[F.max(c).alias(c) for c in names])
    return one.select(
        "requests", "errors", _rate(F.col("requests") - F.col("errors"), F.col("requests")).alias("success_rate"),
        "bytes_in", "bytes_out", "cache_hits", "cache_total",
        _rate(F.col("cache_hits"), F.col("cache_total")).alias("cache_hit_rate"),
        *_LATENCY, "hosts", "uploads", "data_start", "data_end",
        ((F.col("requests") == 0) & (F.col("uploads") == 0)).alias("empty"),
    )


def dashboard_series(rollups: DataFrame, entries: DataFrame, scope: Scope, grain: str = "hour") -> DataFrame:
    """One row per bucket: counts from rollups, exact percentiles from rows."""
    grain = grain if grain in fixed.GRAINS else "hour"
    counts = (
        apply_scope(rollups.where(F.col("grain") == grain), scope, "bucket_start")
        .groupBy("bucket_start").agg(*[F.sum(c).alias(c) for c in _SUMS])
    )
    rows = apply_scope(entries, scope).select(F.date_trunc(grain, "ts").alias("bucket_start"), "latency_ms")
    latency = percentiles_of_counts(
        value_counts(rows, ["bucket_start"], "latency_ms"), ["bucket_start"], "latency_ms", _LATENCY,
    )
    hit_rate = _rate(F.col("cache_hits"), F.col("cache_total")).alias("cache_hit_rate")
    return (
        counts.join(latency, "bucket_start", "left")
        .select("bucket_start", *_SUMS, hit_rate, *_LATENCY).orderBy("bucket_start")
    )


def top_n(entries: DataFrame, scope: Scope, dimension: str, n: int | None = None) -> DataFrame:
    """Busiest values of one allowed dimension."""
    if dimension not in fixed.TOP_DIMENSIONS:
        raise ValueError(f"unknown dimension {dimension!r}")
    label = F.col(fixed.TOP_DIMENSIONS[dimension])
    moved = F.coalesce("req_bytes", F.lit(0)) + F.coalesce("resp_bytes", F.lit(0))
    return (
        apply_scope(entries, scope).where(label.isNotNull())
        .groupBy(label.alias("label"))
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.count_if(labels.is_error(F.col("resp_code"))).alias("errors"),
            F.sum(moved).alias("bytes"),
        )
        .orderBy(F.desc("requests"), "label").limit(clamp(n, fixed.TOP_LIMIT))
    )


def status_breakdown(status: DataFrame, scope: Scope) -> DataFrame:
    """Response codes in the window, with share of all requests.

    p95 is the worst bucket's; ``exact_status_p95`` gives the window's own.
    """
    codes = (
        apply_scope(status, scope, "bucket_start").groupBy(F.col("resp_code").alias("code"))
        .agg(
            F.sum("requests").alias("requests"),
            F.max_by(
                "reason",
                F.when(F.col("reason").isNotNull(), F.struct("requests", "reason")),
            ).alias("reason"),
            F.max("latency_p95").alias("latency_p95"),
        )
    )
    # At most one row per response code reaches this window.
    total = F.sum("requests").over(Window.partitionBy(F.lit(0)))
    return codes.select(
        "code", labels.status_class(F.col("code")).alias("class"), "reason", "requests",
        (F.col("requests") / total).alias("share"), "latency_p95",
    ).orderBy("code")


def exact_status_p95(entries: DataFrame, scope: Scope) -> DataFrame:
    rows = apply_scope(entries, scope).where(F.col("resp_code").isNotNull())
    counts = value_counts(rows, ["resp_code"], "latency_ms")
    return percentiles_of_counts(counts, ["resp_code"], "latency_ms", {"latency_p95": 0.95})


def failures_first(breakdown: DataFrame) -> DataFrame:
    """Server errors, client errors, then the rest; busiest first."""
    order = F.when(F.col("class") == "server_error", 0).when(F.col("class") == "client_error", 1).otherwise(2)
    return breakdown.withColumn("class_rank", order).orderBy("class_rank", F.desc("requests"), "code")


def findings_breakdown(findings: DataFrame, analyses: DataFrame, uploads: DataFrame, scope: Scope) -> DataFrame:
    """Findings per severity and urgency; the window bounds the run's start."""
    runs = analyses.select(F.col("id").alias("analysis_id"), "upload_id", "created_at", "org_id")
    mine = runs.where(
        (F.col("org_id") == F.lit(scope.org_id))
        & (F.col("created_at") >= F.lit(str(scope.start)).cast("timestamp"))
        & (F.col("created_at") < F.lit(str(scope.end)).cast("timestamp"))
    )
    files = uploads.select(F.col("id").alias("upload_id"), "user_id")
    if scope.user_id is not None:
        files = files.where(F.col("user_id") == F.lit(scope.user_id))
    return (
        findings.select("analysis_id", "severity", "urgency")
        .join(mine.join(files, "upload_id").select("analysis_id"), "analysis_id")
        .groupBy("severity", "urgency").agg(F.count(F.lit(1)).alias("findings"))
    )


def findings_matrix(breakdown: DataFrame) -> DataFrame:
    """Zero-filled severity x urgency table, worst severity first."""
    spark = breakdown.sparkSession
    rows = spark.range(1).select(F.explode(F.array(*[F.lit(s) for s in fixed.SEVERITIES])).alias("severity"))
    wide = breakdown.groupBy("severity").pivot("urgency", fixed.URGENCIES).agg(F.sum("findings"))
    filled = rows.join(wide, "severity", "left").na.fill(0, fixed.URGENCIES)
    needed = reduce(lambda a, b: a + b, [F.col(u) for u in fixed.ACTION_URGENCIES])
    return filled.withColumn("action_needed", needed).orderBy(F.desc(labels.severity_rank(F.col("severity"))))


def triage_order():
    return [
        F.desc(labels.urgency_rank(F.col("urgency"))), F.desc(labels.severity_rank(F.col("severity"))),
        F.desc("confidence"),
    ]


def analysis_findings(findings: DataFrame, analysis_id) -> DataFrame:
    """Findings of one run, most urgent first."""
    return findings.where(F.col("analysis_id") == F.lit(analysis_id)).orderBy(*triage_order(), "id")


def action_plan(findings: DataFrame, analyses: DataFrame, visible: DataFrame, n: int | None = None) -> DataFrame:
    """What to do first among the findings of uploads the caller may see."""
    files = visible.select(F.col("id").alias("upload_id"), "filename")
    runs = analyses.select(F.col("id").alias("analysis_id"), "upload_id").join(files, "upload_id")
    return (
        findings.join(runs, "analysis_id")
        .orderBy(*triage_order(), "id").limit(clamp(n, fixed.ACTION_LIMIT))
    )


def worklist_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("urgency").agg(F.count(F.lit(1)).alias("items"))


def data_span(rollups: DataFrame, scope: Scope) -> DataFrame:
    return apply_tenancy(rollups, scope).agg(
        F.min("bucket_start").alias("data_start"), F.max("bucket_start").alias("data_end"),
    )


def entry_counts(entries: DataFrame) -> DataFrame:
    """Entries per upload, parsed and not."""
    parsed = labels.is_parsed(F.col("ts"), F.col("client_ip"))
    return entries.groupBy("upload_id").agg(
        F.count(F.lit(1)).alias("entries"), F.count_if(parsed).alias("parsed"),
        F.count_if(~parsed).alias("unparsed"),
    )


def entry_page(entries: DataFrame, flagged: DataFrame, upload_id, limit: int = fixed.PAGE_SIZE,
               offset: int = 0, flagged_only: bool = False, after: tuple | None = None) -> DataFrame:
    """One page of an upload in line order, with a marker for cited rows.

    ``after`` is the (line_no, id) of the last row of the page before: a filter that is
    pushed down to the scan, so a late page costs what the first does, where ``offset``
    sorts all rows before it. Rows without a line number come before those with one.
    """
    pin(entries.sparkSession)  # the order of a page rests on it
    mine = entries.where(F.col("upload_id") == F.lit(upload_id))
    if after is not None:
        line, row = after
        if line is None:
            mine = mine.where(F.col("line_no").isNotNull() | (F.col("id") > F.lit(row)))
        else:
            # The plain bound is what row groups are skipped by.
            mine = mine.where((F.col("line_no") >= line) & ((F.col("line_no") > line) | (F.col("id") > F.lit(row))))
    ids = flagged.where(F.col("upload_id") == F.lit(upload_id)).select(F.col("entry_id").alias("id")).distinct()
    if flagged_only:
        page = mine.join(ids, "id", "left_semi").withColumn("anomalous", F.lit(True))
        return page.orderBy("line_no", "id").offset(offset).limit(limit)
    # Cut the page first: the marker join then touches one page of rows.
    page = mine.orderBy("line_no", "id").offset(offset).limit(limit)
    marked = page.join(ids.withColumn("anomalous", F.lit(True)), "id", "left")
    return marked.withColumn("anomalous", F.coalesce("anomalous", F.lit(False))).orderBy("line_no", "id")
