"""From scored candidates to findings, overviews and evidence packets."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proxyspark import fixed
from proxyspark.functions import labels
from proxyspark.operators.detectors import BY
from proxyspark.session import PARTITIONS


def fallback_report(candidates: DataFrame, uploads: DataFrame, by=BY) -> DataFrame:
    """Deterministic summary per upload, including uploads with no candidate."""
    by = list(by)
    tops = candidates.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("top"))
    joined = uploads.select(*by).join(tops, by, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    noun = F.when(F.col("n") == 1, "anomaly").otherwise("anomalies")
    text = F.format_string(
        "%d %s detected by statistical analysis. No narrative is available; "
        "explanations come from detector evidence.", F.col("n"), noun)
    return joined.select(
        *by, F.col("n").alias("findings"),
        F.when(F.col("n") == 0, "No anomalies were detected in this log.").otherwise(text).alias("summary"),
        F.when(F.col("n") == 0, "low").otherwise(labels.severity_for_score(F.col("top"))).alias("overall_risk"),
    )


def fallback_findings(candidates: DataFrame, by=BY) -> DataFrame:
    """Report rows built from the candidates alone."""
    return candidates.select(
        *by, "candidate_id", "title", labels.severity_for_score(F.col("score")).alias("severity"),
        F.bround("score", 3).alias("confidence"),
        F.concat(F.lit("Detector '"), "kind", F.lit("' flagged this pattern. Evidence: "), "evidence").alias("explanation"),
        F.lit("Review the highlighted entries.").alias("recommendation"),
    )


def apply_report(report: DataFrame, candidates: DataFrame, by=BY) -> DataFrame:
    """Findings of a report; rows naming no real candidate are dropped.

    ``report`` may carry its own ``urgency``; kind decides where it does not.
    """
    by = list(by)
    if "urgency" not in report.columns:
        report = report.withColumn("urgency", F.lit(None).cast("string"))
    known = candidates.select(*by, "candidate_id", "kind", "entry_count")
    urgency = F.coalesce("urgency", labels.urgency_for_kind(F.col("kind")))
    return report.join(known, [*by, "candidate_id"]).withColumn("urgency", urgency).select(
        *by, "candidate_id", "kind", "severity", "urgency",
        labels.action_required(F.col("urgency")).alias("action_required"),
        labels.action_label(F.col("recommendation")).alias("action_label"),
        "confidence", "explanation", "recommendation", "entry_count",
    )


def rejected_report_rows(report: DataFrame, candidates: DataFrame, by=BY) -> DataFrame:
    keys = [*by, "candidate_id"]
    return report.join(candidates.select(*keys), keys, "left_anti")


def findings_from_candidates(candidates: DataFrame, by=BY) -> DataFrame:
    """Findings without narrative; severity and urgency follow the kind."""
    urgency = labels.urgency_for_kind(F.col("kind"))
    return candidates.select(
        *by, "candidate_id", "kind", labels.severity_for_kind(F.col("kind")).alias("severity"),
        urgency.alias("urgency"), labels.action_required(urgency).alias("action_required"),
        F.lit(None).cast("string").alias("action_label"), F.col("score").alias("confidence"),
        F.col("title").alias("explanation"), F.lit(None).cast("string").alias("recommendation"), "entry_count",
    )


def finding_texts(findings: DataFrame, candidates: DataFrame, by=BY) -> DataFrame:
    """Embedding text per finding, with the entities of its own candidate."""
    keys = [*by, "candidate_id"]
    entities = candidates.select(*keys, *fixed.FINDING_TEXT_FIELDS)
    text = labels.finding_text(
        F.col("kind"), F.col("explanation"), F.col("recommendation"),
        {f: F.col(f) for f in fixed.FINDING_TEXT_FIELDS},
    )
    return findings.join(entities, keys, "left").select(*keys, "kind", text.alias("content"))


def upload_overview(entries: DataFrame, by=BY) -> DataFrame:
    """Whole-upload description used beside the candidates."""
    by = list(by)
    has = lambda c: F.col(c).isNotNull()
    sizes = entries.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_entries"),
        F.coalesce(F.sum(F.when(F.col("req_bytes") > 0, F.col("req_bytes"))), F.lit(0)).alias("total_bytes_sent"),
    )
    # Each dimension folds to its values map-side; counted together in one
    # aggregate, every row would be copied once per dimension first.
    users = entries.where(has("host") & has("username")).groupBy(*by, "username").agg(F.lit(1).alias("distinct_users"))
    addresses = entries.where(has("ts") & has("client_ip")).groupBy(*by, "client_ip").agg(F.lit(1).alias("distinct_client_ips"))
    hosts = entries.where(has("host")).groupBy(*by, "host").agg(F.lit(1).alias("distinct_hosts"))
    counted = ["distinct_users", "distinct_client_ips", "distinct_hosts"]
    for one, name in zip((users, addresses, hosts), counted):
        sizes = sizes.join(one.groupBy(*by).agg(F.count(name).alias(name)), by, "left")
    sizes = sizes.na.fill(0, counted)
    hours = (
        entries.where(has("ts")).groupBy(*by, F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*by).agg(
            F.array_sort(F.collect_list("hour")).alias("hours_covered"),
            F.max_by("hour", F.struct("n", F.negate("hour"))).alias("busiest_hour"),
            F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("hour").cast("string"), "n"))))
            .alias("requests_per_hour"),
        )
    )
    names = entries.where(has("threat_name")).select(*by, "threat_name").distinct()
    order = Window.partitionBy(*by).orderBy("threat_name")
    threats = (
        names.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= fixed.OVERVIEW_THREATS)
        .groupBy(*by).agg(F.array_sort(F.collect_list("threat_name")).alias("threat_names"))
    )
    return sizes.join(hours, by, "left").join(threats, by, "left").withColumn(
        "threat_names", F.coalesce("threat_names", F.array().cast("array<string>")))


def evidence_rows(bridge: DataFrame, entries: DataFrame, by=BY) -> DataFrame:
    """The first few raw lines of each candidate, fetched after scoring."""
    by = list(by)
    key = [*by, "candidate_id"]
    order = Window.partitionBy(*key).orderBy("entry_id")
    first = bridge.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= fixed.SAMPLE_ROWS)
    rows = entries.select(*by, F.col("id").alias("entry_id"), F.left("raw", F.lit(fixed.SAMPLE_CHARS)).alias("line"))
    return first.join(rows, [*by, "entry_id"]).where(F.col("line") != "").select(*key, "entry_id", "line")


def evidence_packets(candidates: DataFrame, overview: DataFrame, samples: DataFrame, by=BY,
                     baseline_json=None, max_chars: int = fixed.PACKET_CHARS,
                     baselines: DataFrame | None = None) -> DataFrame:
    """One bounded JSON document per upload: overview and ranked candidates.

    ``baseline_json`` is one organization baseline for all, or ``baselines``
    holds one per scope (``by``, baseline_json); scopes without one have none.

    Over the limit, all sample lines go first, then candidates from the tail.
    A running length decides the cut; a scope has at most 30 candidates.
    """
    by = list(by)
    key = [*by, "candidate_id"]
    lines = samples.groupBy(*key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("entry_id", "line"))), lambda s: s["line"]).alias("_lines"))
    head = F.struct(
        F.col("candidate_id").alias("id"), "kind", "title", F.bround("score", 3).alias("statistical_confidence"),
        F.col("entry_count").alias("affected_entry_count"),
    )
    open_head = F.expr("substring(_head, 1, length(_head) - 1)")
    part = lambda shown: F.concat(
        open_head, F.lit(',"evidence":'), F.col("evidence"), F.lit(',"sample_log_lines":'), shown, F.lit("}"))
    pieces = candidates.join(lines, key, "left").withColumn("_head", F.to_json(head)).select(
        *by, "rank",
        part(F.coalesce(F.to_json("_lines"), F.lit("[]"))).alias("_full"), part(F.lit("[]")).alias("_bare"),
    )
    tail = F.concat(F.lit("]"), F.concat(F.lit(',"organization_baseline":'), baseline_json), F.lit("}")) \
        if baseline_json is not None else F.lit("]}")
    if baselines is not None:
        given = F.concat(F.lit('],"organization_baseline":'), F.col("baseline_json"), F.lit("}"))
        tail = F.coalesce(given, F.lit("]}"))
        framed = overview.join(baselines.select(*by, "baseline_json"), by, "left")
    else:
        framed = overview
    frame = framed.select(
        *by,
        F.concat(F.lit('{"overview":'), F.to_json(F.struct(*[c for c in overview.columns if c not in by])),
                 F.lit(',"candidates":[')).alias("_open"),
        tail.alias("_close"),
    )
    scope = Window.partitionBy(*by)
    upto = scope.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    room = F.lit(max_chars) - F.length("_open") - F.length("_close")
    comma = F.when(F.col("rank") > 1, 1).otherwise(0)
    fitted = (
        pieces.join(frame, by)
        .withColumn("_with", F.sum(F.length("_full") + comma).over(scope) <= room)
        .withColumn("_text", F.when(F.col("_with"), F.col("_full")).otherwise(F.col("_bare")))
        .withColumn("_upto", F.sum(F.length("_text") + comma).over(upto))
        .where(F.col("_upto") <= room)
    )
    joined = fitted.groupBy(*by).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "_text"))), lambda s: s["_text"]), ",")
        .alias("_body"), F.count(F.lit(1)).alias("candidates_kept"))
    return frame.join(joined, by, "left").select(
        *by, F.coalesce("candidates_kept", F.lit(0)).alias("candidates_kept"),
        F.concat("_open", F.coalesce("_body", F.lit("")), "_close").alias("packet"),
    )


def latest_status(events: DataFrame) -> DataFrame:
    """Current state per run from append-only status events.

    A claim counts only for a run that has not finished; errors are shortened, and are
    so before they travel. An event after the first end counts if it ends the run again,
    so the last one that counts is the last end, or without any the last event: one
    aggregate tells. Runs are dealt over a fixed number of parts, as adaptive execution
    would join parts by their compressed bytes, which texts as alike as errors hide in.
    """
    parts = max(PARTITIONS, int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = events.where(F.col("analysis_id").isNotNull()).select(
        "analysis_id", "event_ts", "status", F.left("error", F.lit(fixed.ERROR_CHARS)).alias("error")).repartition(parts, "analysis_id")
    terminal = F.col("status").isin("done", "failed")
    end = F.when(terminal, F.col("event_ts"))
    last = dealt.groupBy("analysis_id").agg(
        F.min(end).alias("_ended"), F.max(end).alias("finished_at"), F.max("event_ts").alias("_latest"),
        F.max_by(F.struct("status", "error"), end).alias("_end"), F.max_by(F.struct("status", "error"), "event_ts").alias("_last"),
        F.min(F.when(F.col("status") == "running", F.col("event_ts"))).alias("_claimed"))
    ended = F.col("_ended").isNotNull()
    return last.withColumn("_now", F.when(ended, F.col("_end")).otherwise(F.col("_last"))).select(
        "analysis_id", F.col("_now.status").alias("status"), F.coalesce("finished_at", "_latest").alias("updated_at"),
        F.col("_now.error").alias("error"), F.when(~ended | (F.col("_claimed") <= F.col("_ended")), F.col("_claimed")).alias("started_at"),
        "finished_at")


def evaluate(candidates: DataFrame, suspicious, benign, expected: DataFrame) -> DataFrame:
    """Recall over expected attack kinds, false-positive kinds on clean data.

    ``expected`` has (kind, entity). An expected kind is found when any
    candidate has it, and named when one of its entities contains the expected
    one or the other way round.
    """
    hits = candidates.where(F.col("upload_id") == F.lit(suspicious))
    lists = F.from_json("evidence", "hosts array<string>, users array<string>, urls array<string>")
    listed = [F.coalesce(lists[c], F.array().cast("array<string>")) for c in ("hosts", "users", "urls")]
    entity = F.explode(F.array_compact(F.concat(
        F.array(*[F.col(c) for c in fixed.ENTITY_FIELDS]), *listed))).alias("found")
    named = hits.select("kind", entity).distinct().join(expected, "kind").where(
        F.contains("found", F.col("entity")) | F.contains("entity", F.col("found"))
    ).select("kind").distinct().withColumn("named", F.lit(1))
    kinds = hits.select("kind").distinct().withColumn("detected", F.lit(1))
    per_kind = expected.join(kinds, "kind", "left").join(named, "kind", "left").agg(
        F.count(F.lit(1)).alias("expected"), F.coalesce(F.sum("detected"), F.lit(0)).alias("detected"),
        F.coalesce(F.sum("named"), F.lit(0)).alias("named"))
    false_kinds = candidates.where(F.col("upload_id") == F.lit(benign)).agg(
        F.count_distinct("kind").alias("false_positives"))
    one = per_kind.unionByName(false_kinds, allowMissingColumns=True).agg(
        *[F.max(c).alias(c) for c in ("expected", "detected", "named", "false_positives")])
    recall = F.col("detected") / F.col("expected")
    precision = F.coalesce(F.try_divide(F.col("detected"), F.col("detected") + F.col("false_positives")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return (
        one.withColumn("recall", recall).withColumn("precision", precision).withColumn("f1", f1)
        .withColumn("passed", (F.col("recall") == 1) & (F.col("false_positives") == 0))
    )
