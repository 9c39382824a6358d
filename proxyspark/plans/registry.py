"""Every operator as a runnable query over the test tables.

``QUERIES[name](spark, sf_dir)`` returns a DataFrame; ``oracle.SQL[name]`` is
the same question in portable SQL. All read whole tables.
"""

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proxyspark import fixed
from proxyspark.fixtures import load, manifest_of, run_stream, scratch, stored, stored_entries, stored_root
from proxyspark.functions import labels, net, text
from proxyspark.operators import access, dashboard, detectors, findings, history, observability, order_stats, rollups, scope, search, sketches, throttle, vector_index
from proxyspark.operators.scope import Caller, Scope
from proxyspark.plans import ingest
from proxyspark.plans.stored import StoredDashboards
from proxyspark.sources import logs, records, tables, versions
from proxyspark.streaming import rollups as stream_rolls
from proxyspark.streaming import stateful

QUERIES: dict = {}

SCOPE = Scope("org0", datetime(2024, 1, 1), datetime(2024, 2, 1))
RUNS = Scope("org1", datetime(1995, 1, 1), datetime(2002, 1, 1))
NOW = datetime(1998, 6, 1)
MEMBER = Caller(7, "org2", "member")
ADMIN = Caller(1, "org1", "admin")
#: The holder was granted a whole organization in the fixture.
SEARCHERS = {"member": MEMBER, "holder": Caller(646, "org0", "member"), "admin": ADMIN}
INGESTED = datetime(2024, 2, 1)
SALT = "fixture-salt"
TEXT_QUERY = '"thorreou ndernt" -zebra or entretre'
WORD_QUERY = "the of with"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _interim(spark):
    """``write(df, name)``: an interim table in the shared folder, read back."""
    def write(df, name):
        path = scratch(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    return write


def _r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


def _text(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def _org0_uploads(entries: DataFrame) -> DataFrame:
    return entries.groupBy("upload_id", "org_id", "user_id").agg(F.min("ts").alias("created_at"))


# --- rollups and dashboards ------------------------------------------------------

def _rollup_columns(df):
    return df.withColumn("bucket_start", _text("bucket_start"))


@query
def entry_rollups_minute(spark, sf):
    return _rollup_columns(rollups.entry_rollups(stored_entries(spark, sf), "minute"))


@query
def entry_rollups_hour(spark, sf):
    return _rollup_columns(rollups.entry_rollups(stored_entries(spark, sf), "hour"))


@query
def status_rollups(spark, sf):
    return _rollup_columns(rollups.status_rollups(stored_entries(spark, sf)))


@query
def org_baseline(spark, sf):
    hours = rollups.entry_rollups(stored_entries(spark, sf), "hour")
    return rollups.org_baseline(hours, "org0", 30, "up1", datetime(2024, 1, 31))


@query
def timeline(spark, sf):
    return rollups.timeline(stored_entries(spark, sf), ["upload_id"]).withColumn("bucket", _text("bucket"))


@query
def dashboard_summary(spark, sf):
    entries = stored_entries(spark, sf)
    out = dashboard.dashboard_summary(rollups.entry_rollups(entries, "hour"), entries, _org0_uploads(entries), SCOPE)
    return out.withColumns({
        "success_rate": _r("success_rate"), "cache_hit_rate": _r("cache_hit_rate"),
        "data_start": _text("data_start"), "data_end": _text("data_end")})


def _series(spark, sf, grain):
    entries = stored_entries(spark, sf)
    out = dashboard.dashboard_series(rollups.entry_rollups(entries, grain), entries, SCOPE, grain)
    return out.withColumns({"bucket_start": _text("bucket_start"), "cache_hit_rate": _r("cache_hit_rate")})


@query
def dashboard_series_hour(spark, sf):
    return _series(spark, sf, "hour")


@query
def dashboard_series_minute(spark, sf):
    return _series(spark, sf, "minute")


for _dimension in fixed.TOP_DIMENSIONS:
    QUERIES[f"top_{_dimension}"] = lambda spark, sf, d=_dimension: dashboard.top_n(
        stored_entries(spark, sf), SCOPE, d, 20)


@query
def status_breakdown(spark, sf):
    status = rollups.status_rollups(stored_entries(spark, sf))
    return dashboard.status_breakdown(status, SCOPE).withColumn("share", _r("share"))


@query
def failures_first(spark, sf):
    status = rollups.status_rollups(stored_entries(spark, sf))
    return dashboard.failures_first(dashboard.status_breakdown(status, SCOPE)).select(
        "class_rank", "code", "class", "requests")


@query
def exact_status_p95(spark, sf):
    return dashboard.exact_status_p95(stored_entries(spark, sf), SCOPE)


def _runs(spark, sf):
    return [load(spark, sf, t) for t in ("anomalies", "analyses", "uploads")]


@query
def findings_breakdown(spark, sf):
    return dashboard.findings_breakdown(*_runs(spark, sf), RUNS)


@query
def findings_matrix(spark, sf):
    return dashboard.findings_matrix(dashboard.findings_breakdown(*_runs(spark, sf), RUNS))


@query
def action_plan(spark, sf):
    found, runs, uploads = _runs(spark, sf)
    seen = access.visible_uploads(MEMBER, uploads, load(spark, sf, "access_grants"), NOW)
    return dashboard.action_plan(found, runs, seen, 50).select(
        "id", "filename", "kind", "severity", "urgency", _r("confidence"), "entry_count")


@query
def worklist_counts(spark, sf):
    found, runs, uploads = _runs(spark, sf)
    seen = access.visible_uploads(ADMIN, uploads, load(spark, sf, "access_grants"), NOW)
    return dashboard.worklist_counts(dashboard.action_plan(found, runs, seen, 100))


@query
def triage_order(spark, sf):
    """Rank keys of every finding, as the triage order uses them."""
    return load(spark, sf, "anomalies").select(
        "id", labels.urgency_rank(F.col("urgency")).alias("urgency_rank"),
        labels.severity_rank(F.col("severity")).alias("severity_rank"), _r("confidence"),
        labels.action_required(F.col("urgency")).alias("action_required"))


@query
def data_span(spark, sf):
    hours = rollups.entry_rollups(stored_entries(spark, sf), "hour")
    return dashboard.data_span(hours, SCOPE).select(_text("data_start"), _text("data_end"))


@query
def entry_counts(spark, sf):
    return dashboard.entry_counts(stored_entries(spark, sf))


@query
def entry_page(spark, sf):
    entries = stored_entries(spark, sf)
    flagged = entries.where(F.col("threat_name").isNotNull()).select("upload_id", F.col("id").alias("entry_id"))
    page = dashboard.entry_page(entries, flagged, "up0", offset=50)
    return page.select("id", "line_no", _text("ts"), "client_ip", "username", "host", "url", "category", "action",
                       "req_bytes", "resp_bytes", "threat_name", "anomalous")


@query
def entry_page_flagged(spark, sf):
    entries = stored_entries(spark, sf)
    flagged = entries.where(F.col("threat_name").isNotNull()).select("upload_id", F.col("id").alias("entry_id"))
    return dashboard.entry_page(entries, flagged, "up0", flagged_only=True).select("id", "line_no", "threat_name", "anomalous")


@query
def entry_page_after(spark, sf):
    """The second page, from the key of the first one's last row."""
    entries = stored_entries(spark, sf)
    flagged = entries.where(F.col("threat_name").isNotNull()).select("upload_id", F.col("id").alias("entry_id"))
    last = dashboard.entry_page(entries, flagged, "up0").agg(F.max(F.struct("line_no", "id")).alias("key")).first()["key"]
    page = dashboard.entry_page(entries, flagged, "up0", after=tuple(last) if last else None)
    return page.select("id", "line_no", "client_ip", "host", "anomalous")


@query
def scope_violations(spark, sf):
    runs = load(spark, sf, "analyses")
    bad = scope.scope_violations(runs).select("id", F.lit(1).alias("bad"))
    return runs.select("id", "scope").join(bad, "id", "left").groupBy("scope").agg(
        F.count("id").alias("runs"), F.count("bad").alias("violations"))


# --- statistics and detectors -----------------------------------------------------

@query
def robust_baseline(spark, sf):
    rows = load(spark, sf, "lineitem")
    counts = order_stats.value_counts(rows, ["l_suppkey"], "l_extendedprice")
    out = order_stats.robust_baseline(counts, ["l_suppkey"], "l_extendedprice")
    return out.select("l_suppkey", "observations", _r("median", 4), _r("spread", 4))


@query
def exact_percentiles(spark, sf):
    rows = load(spark, sf, "lineitem")
    return order_stats.percentiles(rows, ["l_returnflag"], "l_extendedprice", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


_BASE = ["upload_id", "kind", "title", "score", "entry_count"]


def _flat(df, *evidence):
    cols = [F.col(f"evidence.{e}").alias(e) for e in evidence if e not in _BASE]
    return df.select(*_BASE, *cols).withColumn("score", _r("score"))


@query
def volume_spike(spark, sf):
    return _flat(detectors.volume_spike(stored_entries(spark, sf)), "client_ip", "peak_requests_per_minute",
                 "median_requests_per_minute", "minutes_affected", "window_start", "window_end")


@query
def data_exfil(spark, sf):
    return _flat(detectors.data_exfil(stored_entries(spark, sf)), "username", "host", "total_bytes_sent",
                 "request_count", "largest_request_bytes")


@query
def beaconing(spark, sf):
    return _flat(detectors.beaconing(stored_entries(spark, sf)), "client_ip", "host", "mean_interval_seconds",
                 "interval_stdev_seconds", "regularity", "first_seen", "last_seen")


@query
def blocked_threat(spark, sf):
    out = _flat(detectors.blocked_threat(stored_entries(spark, sf)), "threat_name", "host", "users", "actions")
    return out.withColumns({"users": F.array_join("users", ","), "actions": F.array_join("actions", ",")})


@query
def rare_destination(spark, sf):
    out = _flat(detectors.rare_destination(stored_entries(spark, sf)), "host", "username", "busiest_host_hits", "urls")
    return out.withColumn("urls", F.array_join("urls", ","))


@query
def off_hours(spark, sf):
    out = _flat(detectors.off_hours(stored_entries(spark, sf)), "actor", "hours", "median_hourly_volume",
                "these_hours_volume", "hosts")
    return out.withColumns({"hours": F.array_join(F.col("hours").cast("array<string>"), ","), "hosts": F.array_join("hosts", ",")})


@query
def detect_all(spark, sf):
    return detectors.detect_all(stored_entries(spark, sf)).select(
        "upload_id", "candidate_id", "rank", "kind", "title", _r("score"), "entry_count")


@query
def detect_all_scored(spark, sf):
    """Every candidate that scores, before a packet takes the best few."""
    return detectors.detect_all(stored_entries(spark, sf), per_detector=None).select(
        "upload_id", "rank", "kind", "title", _r("score"), "entry_count")


@query
def finding_entries(spark, sf):
    return detectors.finding_entries(_candidates(spark, sf), stored_entries(spark, sf))


# --- findings -----------------------------------------------------------------------

def _candidates(spark, sf):
    """Candidates as the analysis stores them; findings start from that table."""
    return stored(spark, sf, "candidates", lambda path: detectors.detect_all(stored_entries(spark, sf)).write.parquet(path))


@query
def fallback_report(spark, sf):
    uploads = stored_entries(spark, sf).select("upload_id").distinct()
    return findings.fallback_report(_candidates(spark, sf), uploads)


@query
def fallback_findings(spark, sf):
    return findings.fallback_findings(_candidates(spark, sf)).select(
        "upload_id", "candidate_id", "title", "severity", "confidence", "recommendation")


def _report(spark, sf):
    """An external report: every candidate, plus one made-up handle per upload."""
    base = findings.fallback_findings(_candidates(spark, sf))
    extra = stored_entries(spark, sf).select("upload_id").distinct().select(
        "upload_id", F.lit("c999").alias("candidate_id"), F.lit("x").alias("title"), F.lit("low").alias("severity"),
        F.lit(0.5).alias("confidence"), F.lit("x").alias("explanation"), F.lit("").alias("recommendation"))
    return base.unionByName(extra)


@query
def apply_report(spark, sf):
    return findings.apply_report(_report(spark, sf), _candidates(spark, sf)).select(
        "upload_id", "candidate_id", "kind", "severity", "urgency", "action_required", "action_label", "confidence",
        "entry_count")


@query
def rejected_report_rows(spark, sf):
    return findings.rejected_report_rows(_report(spark, sf), _candidates(spark, sf)).select("upload_id", "candidate_id")


@query
def findings_from_candidates(spark, sf):
    return findings.findings_from_candidates(_candidates(spark, sf)).withColumn("confidence", _r("confidence")).select(
        "upload_id", "candidate_id", "kind", "severity", "urgency", "action_required", "confidence", "explanation")


@query
def finding_texts(spark, sf):
    cands = _candidates(spark, sf)
    return findings.finding_texts(findings.findings_from_candidates(cands), cands)


@query
def upload_overview(spark, sf):
    out = findings.upload_overview(stored_entries(spark, sf))
    per_hour = F.array_join(F.transform(F.array_sort(F.map_entries("requests_per_hour")),
                                        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.withColumns({
        "hours_covered": F.array_join(F.col("hours_covered").cast("array<string>"), ","),
        "threat_names": F.array_join("threat_names", ","), "requests_per_hour": per_hour})


@query
def evidence_rows(spark, sf):
    entries = stored_entries(spark, sf)
    bridge = detectors.finding_entries(_candidates(spark, sf), entries)
    return findings.evidence_rows(bridge, entries)


@query
def evidence_packets(spark, sf):
    entries = stored_entries(spark, sf)
    cands = _candidates(spark, sf)
    samples = findings.evidence_rows(detectors.finding_entries(cands, entries), entries)
    return findings.evidence_packets(cands, findings.upload_overview(entries), samples)


@query
def latest_status(spark, sf):
    items = load(spark, sf, "lineitem")
    status = F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_returnflag") == "A", "running").otherwise("queued")
    events = items.groupBy(
        F.col("l_orderkey").alias("analysis_id"), F.col("l_shipdate").cast("timestamp").alias("event_ts")
    ).agg(F.max(status).alias("status")).withColumn(
        "error", F.when(F.col("status") == "failed", F.repeat(F.lit("e"), 2500)))
    out = findings.latest_status(events)
    return out.select("analysis_id", "status", _text("updated_at"), F.length("error").alias("error_chars"),
                      _text("started_at"), _text("finished_at"))


@query
def evaluate(spark, sf):
    expected = fixed.EXPECTED_ATTACKS
    entity = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("entity")) for k, v in expected.items()]))
    table = spark.range(1).select(entity.alias("e")).select("e.kind", "e.entity")
    out = findings.evaluate(_candidates(spark, sf), "up0", "up1", table)
    return out.withColumns({c: _r(c) for c in ("recall", "precision", "f1")})


# --- access ---------------------------------------------------------------------------

def _tenancy(spark, sf):
    return [load(spark, sf, t) for t in ("users", "uploads", "access_grants")]


@query
def visible_uploads(spark, sf):
    _, uploads, grants = _tenancy(spark, sf)
    return access.visible_uploads(MEMBER, uploads, grants, NOW).withColumn("created_at", _text("created_at"))


@query
def latest_analysis(spark, sf):
    return access.latest_analysis(load(spark, sf, "analyses"))


@query
def list_visible_uploads(spark, sf):
    _, uploads, grants = _tenancy(spark, sf)
    out = access.list_visible_uploads(ADMIN, uploads, grants, load(spark, sf, "analyses"), NOW)
    return out.withColumn("created_at", _text("created_at"))


def _requests(spark, sf):
    """Owner, grant holder and a neighbour each ask for every upload."""
    orders = load(spark, sf, "orders").select("o_orderkey", "o_custkey")
    who = F.explode(F.array(
        F.col("o_custkey"), F.when(F.col("o_custkey") > 25, F.col("o_custkey") - 25).otherwise(F.col("o_custkey") + 25),
        F.when(F.col("o_custkey") > 1, F.col("o_custkey") - 1).otherwise(F.col("o_custkey") + 1)))
    return orders.select(who.alias("user_id"), F.col("o_orderkey").alias("upload_id"))


def _levels(spark, sf):
    return access.resolve_levels(_requests(spark, sf), *_tenancy(spark, sf), NOW)


@query
def resolve_levels(spark, sf):
    return _levels(spark, sf).select("user_id", "upload_id", "role", "level_rank", "level")


@query
def require_level(spark, sf):
    return access.require_level(_levels(spark, sf), "full").select("user_id", "upload_id", "outcome", "effective_level")


@query
def breakglass_audit(spark, sf):
    return access.breakglass_audit(access.require_level(_levels(spark, sf), "full"), NOW).select(
        "org_id", "actor_user_id", "action", "resource_type", "resource_id", "detail", _text("created_at"))


@query
def best_grants(spark, sf):
    return access.best_grants(load(spark, sf, "access_grants"), NOW)


@query
def mask_entry_ids(spark, sf):
    found = load(spark, sf, "anomalies").withColumns({
        "upload_id": F.floor(F.col("analysis_id") / 10), "entry_ids": F.sequence(F.lit(1).cast("bigint"), "entry_count")})
    mine = _levels(spark, sf).where(F.col("user_id") == F.lit(MEMBER.id))
    out = access.mask_entry_ids(found, mine)
    return out.select("id", "upload_id", F.array_join(F.col("entry_ids").cast("array<string>"), ",").alias("entry_ids"))


@query
def list_grants(spark, sf):
    out = access.list_grants(MEMBER, load(spark, sf, "access_grants"))
    return out.withColumns({"created_at": _text("created_at"), "expires_at": _text("expires_at")})


@query
def list_members(spark, sf):
    return access.list_members(MEMBER, load(spark, sf, "users")).withColumn("created_at", _text("created_at"))


@query
def list_audit(spark, sf):
    out = access.list_audit(ADMIN, load(spark, sf, "audit_log"), load(spark, sf, "users"), 200)
    return out.withColumn("created_at", _text("created_at"))


@query
def find_by_email(spark, sf):
    return access.find_by_email(load(spark, sf, "users"), "CUSTOMER#000000007@x.io").select("id", "org_id", "email")


@query
def stale_analyses(spark, sf):
    out = access.stale_analyses(load(spark, sf, "analyses"), load(spark, sf, "uploads"), NOW)
    return out.select("id", "upload_id", "org_id", "user_id", "scope", "baseline_window_days", "status")


@query
def redact(spark, sf):
    hashed = access.redact(stored_entries(spark, sf), {"username": "u_", "client_ip": "ip_"}, SALT)
    return hashed.select("id", "upload_id", "username_hash", "client_ip_hash", "category", "resp_code")


@query
def upsert_grants(spark, sf):
    grants = load(spark, sf, "access_grants")
    changes = grants.select(
        (F.col("id") + 10_000_000).alias("id"), "org_id", "upload_id", "subject_user_id",
        F.lit("full").alias("level"), "granted_by", F.lit(None).cast("timestamp").alias("expires_at"),
        "created_at", F.col("id").alias("seq"))
    out = tables.upsert_grants(_one_per_target(grants), changes)
    return out.select("org_id", "upload_id", "subject_user_id", "level", _text("expires_at"))


@query
def erase_uploads(spark, sf):
    """Rows erased and left per table when every seventh upload is asked for
    and only those of org1 may go."""
    named = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string")).alias(c)
    uploads, grants = load(spark, sf, "uploads"), load(spark, sf, "access_grants")
    parts = {
        "uploads": uploads.select(named("u", "id"), "org_id", "created_at"),
        "analyses": load(spark, sf, "analyses").select(named("a", "id"), named("u", "upload_id"), "status"),
        "findings": load(spark, sf, "anomalies").select("id", named("a", "analysis_id"), "kind"),
        "grants": grants.select("id", named("u", "upload_id"), "subject_user_id", "level"),
    }
    root = scratch(spark, "erase")
    for kind, df in parts.items():
        tables.write_table(df, f"{root}/{kind}", kind, buckets=4)
    asked = uploads.where(F.col("id") % 7 == 0).select(named("u", "id").alias("upload_id"))
    erased = tables.erase_uploads(spark, root, asked, "org1")
    left = [spark.read.parquet(f"{root}/{kind}").agg(F.lit(kind).alias("table_name"), F.count(F.lit(1)).alias("left")) for kind in parts]
    return erased.join(reduce(DataFrame.unionByName, left), "table_name")


def _one_per_target(grants):
    """The fixture may grant one person the organization twice; a stored table
    never holds both."""
    empty = grants.where(F.lit(False))
    return tables.upsert_grants(empty, grants.withColumn("seq", F.col("id")))


# --- search -----------------------------------------------------------------------------

def _documents(spark, sf):
    return load(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("kind"), F.col("text").alias("explanation"))


def _index(spark, sf):
    """The stored token table of all documents, as a search reads it."""
    return stored(spark, sf, "finding_index", lambda path: tables.write_index(
        search.build_finding_index(_documents(spark, sf)), path))


@query
def build_finding_index(spark, sf):
    index = search.build_finding_index(_documents(spark, sf))
    return index.groupBy("form", "field", "token").agg(
        F.count(F.lit(1)).alias("occurrences"), F.count_distinct("finding_id").alias("findings"))


@query
def search_findings_text(spark, sf):
    return search.search_findings_text(_index(spark, sf), _documents(spark, sf), TEXT_QUERY, 100).select("finding_id", "rank")


@query
def search_findings_words(spark, sf):
    return search.search_findings_text(_index(spark, sf), _documents(spark, sf), WORD_QUERY, 50).select("finding_id", "rank")


@query
def search_findings_vector(spark, sf):
    vectors = load(spark, sf, "embeddings")
    # The query is one stored vector: a single row of 64 numbers.
    probe = vectors.where(F.col("vec_id") == 0).select("embedding").first()[0]
    return search.search_findings_vector(vectors, probe, 20, "vec_id").select("vec_id", _r("rank"))


@query
def search_many(spark, sf):
    vectors = load(spark, sf, "embeddings")
    probes = {str(r[0]): r[1] for r in vectors.where(F.col("vec_id").isin(0, 1, 2)).select("vec_id", "embedding").take(3)}
    return search.search_many(vectors, probes, 10, "vec_id").select("vec_id", "query", "place", _r("rank"))


@query
def search_vector_index(spark, sf):
    """The nearest vectors of every fiftieth one, by the approximate index over all rows."""
    vectors, path = load(spark, sf, "embeddings").select("vec_id", "embedding"), scratch(spark, "vector_index")
    vector_index.build_index(vectors, path, "vec_id")
    return vector_index.search_each(spark, path, vectors.where(F.col("vec_id") % 50 == 0), 10, "vec_id").withColumn("rank", _r("rank"))


def _of_runs(df, id_col):
    """Gives documents or vectors a run, as findings have one."""
    return df.withColumn("analysis_id", (F.col(id_col) % 1000 + 1) * 10 + 1)


@query
def search_visible_text(spark, sf):
    found = _of_runs(_documents(spark, sf), "id")
    _, uploads, grants = _tenancy(spark, sf)
    parts = [
        search.search_visible_text(_index(spark, sf), found, load(spark, sf, "analyses"), uploads, grants, caller, NOW, WORD_QUERY, 50)
        .select(F.lit(who).alias("caller"), "finding_id", "upload_id", "rank") for who, caller in SEARCHERS.items()]
    return reduce(DataFrame.unionByName, parts)


@query
def search_visible_vector(spark, sf):
    vectors = load(spark, sf, "embeddings").withColumnRenamed("vec_id", "finding_id")
    probe = vectors.where(F.col("finding_id") == 0).select("embedding").first()[0]
    found = _of_runs(vectors.select(F.col("finding_id").alias("id")), "id")
    _, uploads, grants = _tenancy(spark, sf)
    parts = [
        search.search_visible_vector(vectors, found, load(spark, sf, "analyses"), uploads, grants, caller, NOW, probe, 20)
        .select(F.lit(who).alias("caller"), "finding_id", "upload_id", _r("rank")) for who, caller in SEARCHERS.items()]
    return reduce(DataFrame.unionByName, parts)


@query
def has_embeddings(spark, sf):
    tagged = load(spark, sf, "embeddings").withColumn("org_id", F.concat(F.lit("org"), F.col("label").cast("string")))
    return search.has_embeddings(tagged, "org1")


# --- observability ------------------------------------------------------------------------

def _metrics(spark, sf):
    return load(spark, sf, "metric_events").withColumn("labels", F.create_map("label", "label_value"))


@query
def stage_percentiles(spark, sf):
    return observability.stage_percentiles(load(spark, sf, "analysis_timings"))


@query
def metric_counters(spark, sf):
    return observability.metric_counters(_metrics(spark, sf))


@query
def metric_histograms(spark, sf):
    out = observability.metric_histograms(_metrics(spark, sf))
    return out.withColumns({c: _r(c, 2) for c in ("min", "p50", "p95", "p99", "max", "mean")})


@query
def metric_gauges(spark, sf):
    return observability.metric_gauges(_metrics(spark, sf)).withColumn("value", _r("value", 2))


@query
def derived_ratios(spark, sf):
    return observability.derived_ratios(_metrics(spark, sf))


def _checks(spark, sf):
    return observability.evaluate_alerts(_metrics(spark, sf), {"http_error_rate": 0.2}, window="6 hours")


@query
def evaluate_alerts(spark, sf):
    return _checks(spark, sf).select(_text("window_start"), "alert", _r("value", 4), "threshold", "breached")


@query
def alert_changes(spark, sf):
    return observability.alert_changes(_checks(spark, sf)).select(_text("window_start"), "alert", "state")


# --- log ingest ---------------------------------------------------------------------------

_HEADERS = {
    "a.csv": "datetime,ClientIP,login,host,url,requestsize,respcode,reason",
    "b.tsv": "URL\tsource\tsrc ip\tTime Stamp\tReq Size\tStatus_Code\tuser",
    "c.log": "eventtime|clientpublicip|client IP|user|url|bytes out|status",
}


def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Three differently configured log files rendered from every event."""
    events = load(spark, sf, "events").withColumn(
        "k", F.get_json_object("props", "$.k").cast("int"))
    ip = F.format_string("10.%d.%d.%d", F.col("user_id") % 4, F.col("user_id") % 200, F.col("k"))
    url = F.format_string("https://site%d.com:8443/%s", F.col("k"), F.col("event_type"))
    size = F.when(F.col("k") % 9 == 0, "-").otherwise(F.format_string("%d.75", F.col("k") * 10 - 50))
    user = F.when(F.col("k") % 7 == 0, "None").otherwise(F.format_string("user%d", F.col("user_id")))
    plain = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    code = (F.col("k") + 200).cast("string")
    which = F.col("user_id") % 3
    quoted = F.concat(F.lit('"'), F.col("event_type"), F.lit(', ""k"" '), F.col("k").cast("string"), F.lit('"'))
    line = (
        F.when(which == 0, F.concat_ws(",", plain, ip, user, F.lit(""), url, size, code, quoted))
        .when(which == 1, F.concat_ws("\t", url, F.lit("x"), ip, F.unix_seconds(F.col("ts").cast("timestamp")).cast("string"),
                                      size, code, user))
        .otherwise(F.concat_ws("|", F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss '+0100'"), F.lit("bad"), ip, user, url, size))
    )
    name = F.when(which == 0, "a.csv").when(which == 1, "b.tsv").otherwise("c.log")
    data = events.select(name.alias("file"), (F.col("event_id") + 2).alias("line_no"), line.alias("value"))
    header = F.create_map(*[F.lit(x) for kv in _HEADERS.items() for x in kv])
    heads = data.select("file").distinct().select("file", F.lit(1).cast("bigint").alias("line_no"), header[F.col("file")].alias("value"))
    return data.unionByName(heads)


@query
def detect_format(spark, sf):
    found = logs.detect_format(logs.file_headers(log_lines(spark, sf)))
    return found.select("file", "format", "delimiter", F.to_json("cols").alias("cols"))


@query
def normalize_logs(spark, sf):
    lines = log_lines(spark, sf)
    headers = logs.detect_format(logs.file_headers(lines))
    owners = headers.select("file", F.col("file").alias("upload_id"), F.lit("org0").alias("org_id"), F.lit("own").alias("user_id"))
    out = logs.normalize_logs(lines, headers, INGESTED, owners=owners)
    return out.select("upload_id", "line_no", _text("ts"), "client_ip", "username", "host", "url", "req_bytes", "resp_code", "reason")


@query
def upload_manifest(spark, sf):
    lines = log_lines(spark, sf)
    headers = logs.detect_format(logs.file_headers(lines))
    owners = headers.select("file", F.col("file").alias("upload_id"), F.lit("org0").alias("org_id"), F.lit("own").alias("user_id"))
    entries = logs.normalize_logs(lines, headers, INGESTED, owners=owners)
    sizes = lines.groupBy("file").agg(F.sum(F.length("value") + 1).alias("byte_size"))
    stamp = F.lit(str(INGESTED)).cast("timestamp")
    files = owners.join(headers.select("file", "format"), "file").join(sizes, "file").select(
        "upload_id", "org_id", "user_id", F.col("file").alias("filename"), "byte_size", "format",
        logs.object_key(F.col("org_id"), F.col("user_id"), stamp, F.col("upload_id")).alias("object_key"), stamp.alias("created_at"))
    return logs.upload_manifest(entries, files).withColumn("created_at", _text("created_at"))


@query
def normalize_name(spark, sf):
    return load(spark, sf, "customer").select("c_custkey", text.normalize_name(F.concat(F.lit(" "), F.col("c_name"), F.lit("_X "))).alias("name"))


@query
def clean_value(spark, sf):
    marked = F.when(F.col("c_custkey") % 5 == 0, F.lit(' "-" ')).when(F.col("c_custkey") % 5 == 1, F.lit("N/A")).when(
        F.col("c_custkey") % 5 == 2, F.lit("na")).otherwise(F.concat(F.lit(' "'), F.col("c_name"), F.lit('"')))
    return load(spark, sf, "customer").select("c_custkey", text.clean_value(marked).alias("value"))


@query
def host_from_url(spark, sf):
    return load(spark, sf, "pages").select("page_id", text.host_from_url(F.col("url")).alias("host"))


@query
def parse_long(spark, sf):
    raw = F.when(F.col("c_custkey") % 6 == 0, F.concat(F.col("c_acctbal").cast("decimal(12,2)").cast("string"), F.lit("d"))).otherwise(
        F.col("c_acctbal").cast("decimal(12,2)").cast("string"))
    return load(spark, sf, "customer").select("c_custkey", text.parse_long(raw).alias("value"))


@query
def parse_ts(spark, sf):
    when, key = F.col("o_orderdate"), F.col("o_orderkey") % 7
    # A fraction after a comma for some; numbers that are no instant beside other junk.
    pick = F.col("o_custkey") % 5
    plain = F.concat(F.date_format(when, "yyyy-MM-dd HH:mm:ss"), F.when(pick < 2, ",25").otherwise(""))
    junk = (F.when(pick == 0, "17000000000000000").when(pick == 1, "-170000000000000000").when(pick == 2, "1700000000000000000")
            .when(pick == 3, "17000000000000000000").otherwise(F.date_format(when, "yyyy.MM.dd")))
    raw = (
        F.when(key == 0, plain).when(key == 1, F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(key == 2, F.date_format(when, "yyyy/MM/dd H:mm:ss.SSS")).when(key == 3, F.date_format(when, "dd/MMM/yyyy:HH:mm:ss +0200"))
        .when(key == 4, F.unix_seconds(when.cast("timestamp")).cast("string"))
        .when(key == 5, F.date_format(when, "MMM d HH:mm:ss")).otherwise(junk)
    )
    return load(spark, sf, "orders").select("o_orderkey", F.date_format(text.parse_ts(raw, INGESTED), "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query
def parse_ip(spark, sf):
    raw = F.format_string("%d.%d.%d.%d", F.col("o_custkey") % 260, F.col("o_orderkey") % 256, F.lit(0), F.lit(7))
    return load(spark, sf, "orders").select("o_orderkey", net.parse_ip(raw).alias("ip"), net.ip_v4_key(net.parse_ip(raw)).alias("ip_key"))


@query
def ip_in_cidr(spark, sf):
    return stored_entries(spark, sf).groupBy(net.ip_in_cidr(F.col("client_ip"), "10.12.2.0/23").alias("inside")).agg(
        F.count(F.lit(1)).alias("entries"), F.count_distinct("client_ip").alias("addresses"))


@query
def iso8601(spark, sf):
    return load(spark, sf, "events").select("event_id", text.iso8601(F.col("ts").cast("timestamp")).alias("at"))


@query
def score_from_z(spark, sf):
    z = F.col("value") / 40
    return load(spark, sf, "events").select(
        "event_id", F.round(labels.score_from_z(z, 3.0, 12.0), 6).alias("score"),
        labels.severity_for_score(labels.score_from_z(z, 3.0, 12.0)).alias("severity"))


@query
def kind_labels(spark, sf):
    return load(spark, sf, "anomalies").select(
        "id", labels.urgency_for_kind(F.col("kind")).alias("kind_urgency"), labels.severity_for_kind(F.col("kind")).alias("kind_severity"))


@query
def status_class(spark, sf):
    return stored_entries(spark, sf).groupBy(labels.status_class(F.col("resp_code")).alias("class")).agg(F.count(F.lit(1)).alias("requests"))


# --- streaming: each stream is run over the whole table, then read back ---------------------

@query
def stream_rollups(spark, sf):
    out = run_stream(spark, sf, "stream_rollups", stored_entries(spark, sf), stream_rolls.stream_rollups)
    return _rollup_columns(out)


@query
def alert_transitions(spark, sf):
    out = run_stream(spark, sf, "alert_transitions", _checks(spark, sf), stateful.alert_transitions)
    return out.select(_text("window_start"), "alert", "state")


@query
def heartbeat_timeouts(spark, sf):
    beats = load(spark, sf, "auth_events").select(
        F.col("account").alias("analysis_id"), "ts", F.when(F.col("success"), "done").otherwise("running").alias("status"))
    out = run_stream(spark, sf, "heartbeat_timeouts", beats, stateful.heartbeat_timeouts)
    return out.select("analysis_id", _text("last_seen"), "status")


@query
def login_throttle(spark, sf):
    out = run_stream(spark, sf, "login_throttle", load(spark, sf, "auth_events"), stateful.login_throttle)
    return out.withColumn("ts", _text("ts"))


@query
def throttle_attempts(spark, sf):
    """Both dimensions in one order: a burst of sign-ins in which each address tries each account."""
    auth = load(spark, sf, "auth_events").withColumn("ip", F.concat(F.lit("10.0.0."), (F.col("id") % 20).cast("string")))
    start = F.unix_micros(F.lit("2024-01-01").cast("timestamp"))
    burst = auth.withColumn("ts", F.timestamp_micros(start + F.floor((F.unix_micros("ts") - start) / 500)))
    out = throttle.throttle_attempts(burst, scratch(spark, "throttle"))
    return out.select("id", "ip", "account", "decision", "ip_failures", "account_failures")


@query
def alert_transitions_shuffled(spark, sf):
    """The same changes when checks come at random in seven micro-batches."""
    checks = _checks(spark, sf).select("window_start", "alert", "value", "breached")
    end = spark.range(1).select(F.lit("2030-01-01").cast("timestamp").alias("window_start"), F.lit("end").alias("alert"),
                                F.lit(0.0).alias("value"), F.lit(False).alias("breached"))
    out = run_stream(spark, sf, "alert_transitions_shuffled", checks, lambda s: stateful.alert_transitions(s, "60 days"), 7, end)
    return out.select(_text("window_start"), "alert", "state")


@query
def heartbeat_timeouts_shuffled(spark, sf):
    beats = load(spark, sf, "auth_events").select(
        F.col("account").alias("analysis_id"), "ts", F.when(F.col("success"), "done").otherwise("running").alias("status"))
    end = spark.range(1).select(F.lit("end").alias("analysis_id"), F.lit("2030-01-01").cast("timestamp").alias("ts"), F.lit("done").alias("status"))
    out = run_stream(spark, sf, "heartbeat_timeouts_shuffled", beats, lambda s: stateful.heartbeat_timeouts(s, watermark="60 days"), 7, end)
    return out.select("analysis_id", _text("last_seen"), "status")


@query
def live_rollups(spark, sf):
    """Rollups kept complete while rows come at random in four micro-batches."""
    root, entries = scratch(spark, "live"), stored_entries(spark, sf).drop("month", "bucket")
    entries.repartition(4, F.rand(3)).write.parquet(f"{root}/feed")
    files = spark.readStream.schema(entries.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/feed")
    stream_rolls.keep_rollups(files, root, f"{root}/checkpoint", buckets=2).trigger(availableNow=True).start().awaitTermination()
    return _rollup_columns(spark.read.parquet(f"{root}/live_rollups").drop("day", "bucket"))


# --- stored tables: written as versions, read back through the pointer -----------------------

def _table_counts(spark, root):
    parts = []
    for kind in versions.VERSIONED:
        of = F.col("id" if kind == "uploads" else "upload_id")
        parts.append(versions.read_committed(spark, root, kind).groupBy(of.alias("upload_id")).agg(
            F.lit(kind).alias("table_name"), F.count(F.lit(1)).alias("rows")))
    return reduce(DataFrame.unionByName, parts)


@query
def ingest_tables(spark, sf):
    """Rows per upload in every table after one ingest."""
    return _table_counts(spark, stored_root(spark, sf))


@query
def reingest_tables(spark, sf):
    """The same after one of two uploads, in a bucket they share, came again without
    its blocked requests and the other stayed."""
    root, entries = scratch(spark, "again"), stored_entries(spark, sf)
    ingest.store(spark, root, entries, manifest_of(entries), "first", 1)
    again = entries.where("upload_id = 'up0' AND action <> 'Blocked'")
    ingest.store(spark, root, again, manifest_of(again), "second", 1)
    return _table_counts(spark, root)


@query
def stored_summary(spark, sf):
    out = StoredDashboards(spark, stored_root(spark, sf)).summary(SCOPE)
    return out.withColumns({
        "success_rate": _r("success_rate"), "cache_hit_rate": _r("cache_hit_rate"),
        "data_start": _text("data_start"), "data_end": _text("data_end")})


def _stored_series(spark, sf, grain):
    out = StoredDashboards(spark, stored_root(spark, sf)).series(SCOPE, grain)
    return out.withColumns({"bucket_start": _text("bucket_start"), "cache_hit_rate": _r("cache_hit_rate")})


@query
def stored_series_hour(spark, sf):
    return _stored_series(spark, sf, "hour")


@query
def stored_series_minute(spark, sf):
    return _stored_series(spark, sf, "minute")


@query
def stored_status_breakdown(spark, sf):
    return StoredDashboards(spark, stored_root(spark, sf)).status(SCOPE).withColumn("share", _r("share"))


@query
def stored_data_span(spark, sf):
    return StoredDashboards(spark, stored_root(spark, sf)).span(SCOPE).select(_text("data_start"), _text("data_end"))


@query
def stored_subnet(spark, sf):
    """Entries of a subnet by the stored address key."""
    found = StoredDashboards(spark, stored_root(spark, sf)).in_subnet(SCOPE, "10.12.2.0/23")
    return found.groupBy("upload_id").agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("client_ip").alias("addresses"))


@query
def latency_sketch_error(spark, sf):
    """Whether merged hourly sketches keep every percentile's rank within 3 per cent."""
    root = stored_root(spark, sf)
    found = StoredDashboards(spark, root).sketched(SCOPE, ["upload_id"])
    out = sketches.rank_errors(found, versions.read_committed(spark, root, "entries"), SCOPE, ["upload_id"])
    return out.select("upload_id", "observations", *[(F.col(f"{n}_error") <= 0.03).alias(f"{n}_close") for n in sketches.FRACTIONS])


def _history_runs(spark, sf):
    """Every analysis as a run against history, of one of two uploads or a third."""
    k = F.col("id").cast("int")
    return load(spark, sf, "analyses").select(
        "id", F.lit("org0").alias("org_id"), F.when(k % 3 == 0, "up0").when(k % 3 == 1, "up1").otherwise("other").alias("upload_id"),
        (F.lit("2024-01-05").cast("timestamp") + F.make_dt_interval(k % 40, k % 24)).alias("created_at"), (k % 30 + 1).alias("baseline_window_days"))


@query
def history_baselines(spark, sf):
    hours = StoredDashboards(spark, stored_root(spark, sf)).rollups("hour")
    return history.history_baselines(hours, _history_runs(spark, sf), _interim(spark))


# --- records over line breaks ------------------------------------------------------------------

def _quoted_files(spark, sf):
    """Every event as a record whose reason spans lines, in four files of many splits."""
    events = load(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    reason = (
        F.when(F.col("k") % 5 == 0, F.concat(F.lit('"first '), F.col("event_type"), F.lit('\n\nsecond, ""k"" '), F.col("k").cast("string"), F.lit('"')))
        .when(F.col("k") % 5 == 1, F.concat(F.lit('"\n'), F.col("k").cast("string"), F.lit('\n"')))
        .when(F.col("k") % 5 == 2, F.lit('5" wide')).otherwise(F.col("event_type")))
    line = F.concat_ws(",", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.format_string("10.0.0.%d", F.col("k")),
                       F.format_string("user%d", F.col("user_id")), reason, F.lit("200"))
    name = F.concat(F.lit("f"), (F.col("user_id") % 4).cast("string"))
    body = events.select(name.alias("name"), F.col("event_id").alias("at"), line.alias("value"))
    heads = body.select("name").distinct().select("name", F.lit(-1).cast("bigint").alias("at"), F.lit("datetime,ClientIP,login,reason,respcode").alias("value"))
    path = scratch(spark, "quoted")
    body.unionByName(heads).repartition("name").sortWithinPartitions("name", "at").select("name", "value").write.partitionBy("name").text(path)
    return path


@query
def quoted_records(spark, sf):
    def archive(path):
        files, usual = _quoted_files(spark, sf), spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
        try:
            tables.archive_raw(logs.scan_logs(spark, files, blank=True), path)
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", usual)

    raw, write = stored(spark, sf, "quoted_lines", archive), _interim(spark)
    headers = write(logs.detect_format(logs.file_headers(raw.where(F.length("value") > 0))), "quoted_headers")
    found = write(records.with_numbers(records.places(raw, headers)), "quoted_places")
    owners = headers.select("file", F.regexp_extract("file", "name=(f[0-9])", 1).alias("upload_id"), F.lit("org0").alias("org_id"), F.lit("own").alias("user_id"))
    out = logs.normalize_logs(records.records(raw, headers, found, write), headers, INGESTED, owners=owners)
    return out.select("upload_id", "line_no", _text("ts"), "client_ip", "username", F.replace("reason", F.lit("\n"), F.lit("/")).alias("reason"), "resp_code")
