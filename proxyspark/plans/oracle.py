"""The registered queries as portable SQL, for checking results in DuckDB."""

from proxyspark import fixed
from proxyspark.fixtures import with_views

SQL: dict[str, str] = {}

_TIME = "strftime({0}, '%Y-%m-%d %H:%M:%S')"


def _ts(column: str, name: str | None = None) -> str:
    return f"{_TIME.format(column)} AS {name or column.split('.')[-1]}"


def _iso(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%dT%H:%M:%S+00:00')"


def _pct(p: float, column: str = "latency_ms") -> str:
    return f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})"


_LATENCY = f"{_pct(0.5)} AS latency_p50, {_pct(0.95)} AS latency_p95, {_pct(0.99)} AS latency_p99"


def _rollup(grain: str) -> str:
    return f"""SELECT org_id, user_id, upload_id, coalesce(host, '') AS host, '{grain}' AS grain,
  CAST(date_trunc('{grain}', ts) AS TIMESTAMP) AS bucket_start, count(*) AS requests,
  CAST(coalesce(sum(resp_bytes), 0) AS BIGINT) AS bytes_in, CAST(coalesce(sum(req_bytes), 0) AS BIGINT) AS bytes_out,
  count(*) FILTER (WHERE resp_code >= 400) AS errors,
  count(*) FILTER (WHERE cache_status IS NOT NULL AND upper(cache_status) LIKE '%HIT%') AS cache_hits,
  count(cache_status) AS cache_total, {_LATENCY}, count(latency_ms) AS latency_count
FROM log_entries WHERE ts IS NOT NULL GROUP BY 1, 2, 3, 4, 5, 6"""


_STATUS = f"""SELECT org_id, user_id, upload_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS bucket_start, resp_code,
  min(reason) AS reason, count(*) AS requests, {_pct(0.95)} AS latency_p95
FROM log_entries WHERE ts IS NOT NULL AND resp_code IS NOT NULL GROUP BY 1, 2, 3, 4, 5"""

_IN_SCOPE = "org_id = 'org0' AND {0} >= TIMESTAMP '2024-01-01' AND {0} < TIMESTAMP '2024-02-01'"


def _entries(sql: str) -> str:
    return with_views(sql, "log_entries")


def _with(sql: str, views: list[str], **ctes: str) -> str:
    head = with_views("", *views).rstrip()
    return head + "".join(f",\n{n} AS ({q})" for n, q in ctes.items()) + "\n" + sql


for _grain in fixed.GRAINS:
    SQL[f"entry_rollups_{_grain}"] = _with(
        f"SELECT * REPLACE ({_TIME.format('bucket_start')} AS bucket_start) FROM r", ["log_entries"], r=_rollup(_grain))
    SQL[f"dashboard_series_{_grain}"] = _with(f"""
SELECT {_ts('c.bucket_start')}, requests, errors, bytes_in, bytes_out, cache_hits, cache_total,
  round(CASE WHEN cache_total > 0 THEN CAST(cache_hits AS DOUBLE) / cache_total END, 6) AS cache_hit_rate,
  latency_p50, latency_p95, latency_p99
FROM (SELECT bucket_start, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(errors) AS BIGINT) AS errors,
  CAST(sum(bytes_in) AS BIGINT) AS bytes_in, CAST(sum(bytes_out) AS BIGINT) AS bytes_out,
  CAST(sum(cache_hits) AS BIGINT) AS cache_hits, CAST(sum(cache_total) AS BIGINT) AS cache_total
  FROM r WHERE {_IN_SCOPE.format('bucket_start')} GROUP BY 1) c
LEFT JOIN (SELECT CAST(date_trunc('{_grain}', ts) AS TIMESTAMP) AS bucket_start, {_LATENCY} FROM log_entries
  WHERE {_IN_SCOPE.format('ts')} AND latency_ms IS NOT NULL GROUP BY 1) l ON l.bucket_start = c.bucket_start
ORDER BY 1""", ["log_entries"], r=_rollup(_grain))

SQL["status_rollups"] = _with(f"SELECT * REPLACE ({_TIME.format('bucket_start')} AS bucket_start) FROM s", ["log_entries"], s=_STATUS)
SQL["org_baseline"] = _with(f"""
SELECT 30 AS window_days, CAST(coalesce(sum(requests), 0) AS BIGINT) AS requests,
  CAST(coalesce(sum(errors), 0) AS BIGINT) AS errors, count(DISTINCT host) AS hosts,
  CAST(coalesce({_pct(0.5, 'requests')}, 0) AS DOUBLE) AS median_hourly_requests
FROM r WHERE org_id = 'org0' AND bucket_start >= TIMESTAMP '2024-01-31' - INTERVAL 30 DAY AND upload_id <> 'up1'
""", ["log_entries"], r=_rollup("hour"))
SQL["timeline"] = _entries(f"""
SELECT upload_id, {_ts("to_timestamp(floor(epoch(ts) / 900) * 900) AT TIME ZONE 'UTC'", 'bucket')}, count(*) AS total
FROM log_entries WHERE ts IS NOT NULL GROUP BY 1, 2""")
SQL["dashboard_summary"] = _with(f"""
SELECT requests, errors, round(CASE WHEN requests > 0 THEN CAST(requests - errors AS DOUBLE) / requests END, 6) AS success_rate,
  bytes_in, bytes_out, cache_hits, cache_total,
  round(CASE WHEN cache_total > 0 THEN CAST(cache_hits AS DOUBLE) / cache_total END, 6) AS cache_hit_rate,
  latency_p50, latency_p95, latency_p99, hosts, uploads, {_ts('data_start')}, {_ts('data_end')},
  (requests = 0 AND uploads = 0) AS empty
FROM (SELECT CAST(coalesce(sum(requests), 0) AS BIGINT) AS requests, CAST(coalesce(sum(errors), 0) AS BIGINT) AS errors,
  CAST(coalesce(sum(bytes_in), 0) AS BIGINT) AS bytes_in, CAST(coalesce(sum(bytes_out), 0) AS BIGINT) AS bytes_out,
  CAST(coalesce(sum(cache_hits), 0) AS BIGINT) AS cache_hits, CAST(coalesce(sum(cache_total), 0) AS BIGINT) AS cache_total,
  count(DISTINCT host) AS hosts FROM r WHERE {_IN_SCOPE.format('bucket_start')}),
 (SELECT {_LATENCY} FROM log_entries WHERE {_IN_SCOPE.format('ts')} AND latency_ms IS NOT NULL),
 (SELECT count(*) AS uploads FROM (SELECT upload_id, org_id, min(ts) AS t FROM log_entries GROUP BY 1, 2) WHERE {_IN_SCOPE.format('t')}),
 (SELECT min(bucket_start) AS data_start, max(bucket_start) AS data_end FROM r WHERE org_id = 'org0')
""", ["log_entries"], r=_rollup("hour"))
SQL["data_span"] = _with(f"""SELECT {_ts('min(bucket_start)', 'data_start')}, {_ts('max(bucket_start)', 'data_end')}
FROM r WHERE org_id = 'org0'""", ["log_entries"], r=_rollup("hour"))

for _dim, _col in fixed.TOP_DIMENSIONS.items():
    SQL[f"top_{_dim}"] = _entries(f"""
SELECT {_col} AS label, count(*) AS requests, count(*) FILTER (WHERE resp_code >= 400) AS errors,
  CAST(coalesce(sum(coalesce(req_bytes, 0) + coalesce(resp_bytes, 0)), 0) AS BIGINT) AS bytes
FROM log_entries WHERE {_IN_SCOPE.format('ts')} AND {_col} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")

_CLASS = """CASE WHEN {0} >= 500 THEN 'server_error' WHEN {0} >= 400 THEN 'client_error' WHEN {0} >= 300 THEN 'redirect' ELSE 'success' END"""
_BREAKDOWN = f"""
SELECT resp_code AS code, {_CLASS.format('resp_code')} AS class,
  arg_max(reason, lpad(CAST(requests AS VARCHAR), 20, '0') || reason) FILTER (WHERE reason IS NOT NULL) AS reason,
  CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(requests) AS DOUBLE) / sum(sum(requests)) OVER () AS share,
  max(latency_p95) AS latency_p95
FROM s WHERE {_IN_SCOPE.format('bucket_start')} GROUP BY resp_code"""
SQL["status_breakdown"] = _with("SELECT * REPLACE (round(share, 6) AS share) FROM b", ["log_entries"], s=_STATUS, b=_BREAKDOWN)
SQL["failures_first"] = _with("""
SELECT CASE class WHEN 'server_error' THEN 0 WHEN 'client_error' THEN 1 ELSE 2 END AS class_rank, code, class, requests
FROM b ORDER BY 1, 4 DESC, 2""", ["log_entries"], s=_STATUS, b=_BREAKDOWN)
SQL["exact_status_p95"] = _entries(f"""
SELECT resp_code, {_pct(0.95)} AS latency_p95 FROM log_entries
WHERE {_IN_SCOPE.format('ts')} AND resp_code IS NOT NULL AND latency_ms IS NOT NULL GROUP BY 1""")

_SEV = "list_position(['info', 'low', 'medium', 'high', 'critical'], {0})"
_URG = "list_position(['monitor', 'this_week', 'today', 'immediate'], {0})"
_LEVEL = "list_position(['summary', 'dashboard', 'full'], {0})"
_RUN_SCOPE = "a.org_id = 'org1' AND a.created_at >= TIMESTAMP '1995-01-01' AND a.created_at < TIMESTAMP '2002-01-01'"
_FOUND = f"""SELECT severity, urgency, count(*) AS findings FROM anomalies an JOIN analyses a ON a.id = an.analysis_id
JOIN uploads up ON up.id = a.upload_id WHERE {_RUN_SCOPE} AND up.user_id IS NOT NULL GROUP BY 1, 2"""
SQL["findings_breakdown"] = with_views(_FOUND, "anomalies", "analyses", "uploads")
SQL["findings_matrix"] = _with(f"""
SELECT s.severity, {', '.join(f"CAST(coalesce(sum(findings) FILTER (WHERE urgency = '{u}'), 0) AS BIGINT) AS {u}" for u in fixed.URGENCIES)},
  CAST(coalesce(sum(findings) FILTER (WHERE urgency IN ('immediate', 'today')), 0) AS BIGINT) AS action_needed
FROM (SELECT unnest(['info', 'low', 'medium', 'high', 'critical']) AS severity) s LEFT JOIN f ON f.severity = s.severity
GROUP BY s.severity""", ["anomalies", "analyses", "uploads"], f=_FOUND)


def _visible(org: str, user: int, admin: bool) -> str:
    return f"""SELECT up.* FROM uploads up WHERE up.org_id = '{org}' AND (up.user_id = {user} OR {admin} OR EXISTS (
  SELECT 1 FROM access_grants g WHERE g.subject_user_id = {user} AND g.org_id = up.org_id
  AND (g.upload_id = up.id OR g.upload_id IS NULL)
  AND (g.expires_at IS NULL OR g.expires_at > TIMESTAMP '1998-06-01')))"""


_MEMBER, _ADMIN = _visible("org2", 7, False), _visible("org1", 1, True)
_PLAN = """SELECT an.id, up.filename, an.kind, an.severity, an.urgency, round(an.confidence, 6) AS confidence, an.entry_count
FROM anomalies an JOIN analyses a ON a.id = an.analysis_id JOIN v up ON up.id = a.upload_id
ORDER BY """ + _URG.format("an.urgency") + " DESC, " + _SEV.format("an.severity") + " DESC, an.confidence DESC, an.id LIMIT {0}"
_RUN_VIEWS = ["uploads", "access_grants", "analyses", "anomalies"]
SQL["action_plan"] = _with(_PLAN.format(50), _RUN_VIEWS, v=_MEMBER)
SQL["worklist_counts"] = _with(f"SELECT urgency, count(*) AS items FROM ({_PLAN.format(100)}) GROUP BY 1", _RUN_VIEWS, v=_ADMIN)
SQL["triage_order"] = with_views(f"""
SELECT id, CAST({_URG.format('urgency')} AS INT) AS urgency_rank, CAST({_SEV.format('severity')} AS INT) AS severity_rank,
  round(confidence, 6) AS confidence, urgency IN ('immediate', 'today') AS action_required FROM anomalies""", "anomalies")
SQL["entry_counts"] = _entries("""
SELECT upload_id, count(*) AS entries, count(*) FILTER (WHERE ts IS NOT NULL OR client_ip IS NOT NULL) AS parsed,
  count(*) FILTER (WHERE ts IS NULL AND client_ip IS NULL) AS unparsed FROM log_entries GROUP BY 1""")
SQL["entry_page"] = _entries(f"""
SELECT id, line_no, {_ts('ts')}, client_ip, username, host, url, category, action, req_bytes, resp_bytes, threat_name,
  threat_name IS NOT NULL AS anomalous FROM log_entries WHERE upload_id = 'up0' ORDER BY line_no, id LIMIT 25 OFFSET 50""")
SQL["entry_page_flagged"] = _entries("""
SELECT id, line_no, threat_name, true AS anomalous FROM log_entries
WHERE upload_id = 'up0' AND threat_name IS NOT NULL ORDER BY line_no, id LIMIT 25""")
SQL["entry_page_after"] = _entries("""
SELECT id, line_no, client_ip, host, threat_name IS NOT NULL AS anomalous FROM log_entries
WHERE upload_id = 'up0' ORDER BY line_no, id LIMIT 25 OFFSET 25""")
SQL["scope_violations"] = with_views("""
SELECT scope, count(*) AS runs, count(*) FILTER (WHERE (scope = 'file') <> (baseline_window_days IS NULL)) AS violations
FROM analyses GROUP BY 1""", "analyses")

# --- statistics and detectors --------------------------------------------------------
SQL["robust_baseline"] = """
WITH m AS (SELECT l_suppkey, count(*) AS observations, median(l_extendedprice) AS med, stddev_pop(l_extendedprice) AS sd
  FROM lineitem GROUP BY 1),
d AS (SELECT m.l_suppkey, 1.4826 * median(abs(l_extendedprice - med)) AS mad FROM lineitem l JOIN m ON m.l_suppkey = l.l_suppkey GROUP BY 1)
SELECT m.l_suppkey, observations, round(med, 4) AS median, round(CASE WHEN mad > 0 THEN mad ELSE sd END, 4) AS spread
FROM m JOIN d ON d.l_suppkey = m.l_suppkey"""
SQL["exact_percentiles"] = f"""SELECT l_returnflag, {_pct(0.5, 'l_extendedprice')} AS p50,
  {_pct(0.95, 'l_extendedprice')} AS p95, {_pct(0.99, 'l_extendedprice')} AS p99 FROM lineitem GROUP BY 1"""


def _cap(source: str) -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY score DESC, title) AS place
  FROM ({source}) WHERE score >= 0.30) WHERE place <= 5"""


def _uncapped(sql: str) -> str:
    return sql.replace("WHERE place <= 5", "")


def _spread(values: str, v: str) -> str:
    """upload_id, n, med, spread of a per-upload distribution."""
    return f"""SELECT upload_id, n, med, CASE WHEN mad > 0 THEN mad ELSE sd END AS spread FROM (
  SELECT b.upload_id, max(n) AS n, max(med) AS med, max(sd) AS sd, 1.4826 * median(abs({v} - med)) AS mad
  FROM ({values}) x JOIN (SELECT upload_id, count(*) AS n, CAST(median({v}) AS DOUBLE) AS med, stddev_pop({v}) AS sd
    FROM ({values}) GROUP BY 1) b ON b.upload_id = x.upload_id GROUP BY b.upload_id)"""


def _z_score(value: str, flag: float, certain: float) -> str:
    z = f"CASE WHEN spread = 0 THEN CASE WHEN {value} <= med THEN 0.0 ELSE 50.0 END ELSE ({value} - med) / spread END"
    return f"CASE WHEN {z} <= {flag} THEN 0.0 ELSE least(CAST(1.0 AS DOUBLE), CAST(({z}) - {flag} AS DOUBLE) / {certain - flag}) END"


_MINUTES = """SELECT upload_id, client_ip, CAST(date_trunc('minute', ts) AS TIMESTAMP) AS minute, count(*) AS hits
FROM log_entries WHERE client_ip IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2, 3"""
_BURSTS = f"""SELECT * FROM (SELECT m.*, med, {_z_score('hits', 3.0, 10.0)} AS score FROM minutes m
  JOIN ({_spread('SELECT upload_id, hits FROM minutes', 'hits')}) b ON b.upload_id = m.upload_id WHERE n >= 5 AND hits >= 20) WHERE score > 0"""
_SPIKE = _cap("""SELECT upload_id, 'volume_spike' AS kind, 'Request burst from ' || client_ip AS title, max(score) AS score,
  CAST(sum(hits) AS BIGINT) AS entry_count, client_ip, max(hits) AS peak_requests_per_minute,
  max(med) AS median_requests_per_minute, count(*) AS minutes_affected, min(minute) AS first, max(minute) AS last
  FROM bursts GROUP BY upload_id, client_ip""")
_LOGS = "SELECT upload_id, log10(req_bytes) AS v FROM log_entries WHERE req_bytes > 0"
_EXFIL = _cap(f"""SELECT upload_id, 'data_exfil' AS kind, 'Large outbound transfer: ' || username || ' → ' || host AS title,
  {_z_score('log10(largest)', 3.0, 7.0)} AS score, entry_count, username, host, total AS total_bytes_sent,
  entry_count AS request_count, largest AS largest_request_bytes
  FROM (SELECT p.*, b.n, b.med, b.spread FROM (SELECT upload_id, coalesce(username, 'unknown') AS username, coalesce(host, 'unknown') AS host,
    max(req_bytes) AS largest, CAST(sum(req_bytes) AS BIGINT) AS total, count(*) AS entry_count
    FROM log_entries WHERE req_bytes > 0 GROUP BY 1, 2, 3) p JOIN ({_spread(_LOGS, 'v')}) b ON b.upload_id = p.upload_id WHERE n >= 10)""")
_BEACON = _cap("""SELECT upload_id, 'beaconing' AS kind, 'Periodic check-in: ' || client_ip || ' → ' || host AS title,
  least(CAST(1.0 AS DOUBLE), (regularity - 0.80) / 0.18) AS score, entry_count, client_ip, host, mean_gap, gap_stdev, regularity, first, last
  FROM (SELECT *, 1 - gap_stdev / mean_gap AS regularity FROM (
    SELECT upload_id, client_ip, host, max(hits) AS entry_count, avg(gap) FILTER (WHERE gap > 0) AS mean_gap,
      stddev_pop(gap) FILTER (WHERE gap > 0) AS gap_stdev, count(*) FILTER (WHERE gap > 0) AS gaps, min(ts) AS first, max(ts) AS last
    FROM (SELECT upload_id, client_ip, host, ts, count(*) OVER (PARTITION BY upload_id, client_ip, host) AS hits,
        (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY upload_id, client_ip, host ORDER BY ts)) / 1e6 AS gap
      FROM log_entries WHERE client_ip IS NOT NULL AND host IS NOT NULL AND ts IS NOT NULL)
    GROUP BY 1, 2, 3) WHERE entry_count >= 12 AND gaps >= 11 AND mean_gap BETWEEN 5 AND 86400)
  WHERE regularity >= 0.80""")
_THREAT = _cap("""SELECT upload_id, 'blocked_threat' AS kind, threat_name || ' at ' || coalesce(host, 'unknown') AS title,
  CAST(0.95 AS DOUBLE) AS score, count(*) AS entry_count, threat_name, coalesce(host, 'unknown') AS host,
  string_agg(DISTINCT username, ',' ORDER BY username) AS users, string_agg(DISTINCT action, ',' ORDER BY action) AS actions
  FROM log_entries WHERE threat_name IS NOT NULL GROUP BY upload_id, threat_name, coalesce(host, 'unknown')""")
_HOSTS = """SELECT upload_id, host, count(*) AS hits, count(DISTINCT username) AS users, min(username) AS username,
  list_sort(list_distinct(list(url) FILTER (WHERE url IS NOT NULL))) AS urls FROM log_entries WHERE host IS NOT NULL GROUP BY 1, 2"""
_RARE = _cap("""SELECT h.upload_id, 'rare_destination' AS kind, 'Rarely-seen destination: ' || host AS title,
  round(least(CAST(1.0 AS DOUBLE), log10(busiest / CAST(hits AS DOUBLE) + 1) / log10(busiest + 1)), 3) AS score, hits AS entry_count,
  host, username, busiest AS busiest_host_hits, array_to_string(urls[1:3], ',') AS urls
  FROM hosts h JOIN (SELECT upload_id, max(hits) AS busiest, count(*) AS n FROM hosts GROUP BY 1) b ON b.upload_id = h.upload_id
  WHERE n >= 5 AND users = 1 AND hits <= 3""")
_ACTOR = "coalesce(username, client_ip, 'unknown')"
_QUIET = """SELECT h.upload_id, hour, volume, med FROM (SELECT upload_id, extract(HOUR FROM ts) AS hour, count(*) AS volume
    FROM log_entries WHERE ts IS NOT NULL GROUP BY 1, 2) h JOIN (SELECT upload_id, median(volume) AS med, count(*) AS n FROM (
    SELECT upload_id, extract(HOUR FROM ts) AS hour, count(*) AS volume FROM log_entries WHERE ts IS NOT NULL GROUP BY 1, 2) GROUP BY 1) m
  ON m.upload_id = h.upload_id WHERE n >= 4 AND volume < 0.15 * med"""
_OFF = _cap(f"""SELECT upload_id, 'off_hours' AS kind, 'Off-hours activity: ' || actor AS title,
  round(least(CAST(1.0 AS DOUBLE), (1 - volume / median) * least(CAST(1.0 AS DOUBLE), entry_count / 10.0)), 3) AS score, entry_count, actor,
  hours, median AS median_hourly_volume, round(volume, 1) AS these_hours_volume, hosts FROM (
    SELECT x.upload_id, actor, CAST(sum(n) AS BIGINT) AS entry_count, avg(volume) AS volume, max(med) AS median,
      string_agg(CAST(x.hour AS VARCHAR), ',' ORDER BY x.hour) AS hours, array_to_string(list_sort(list_distinct(flatten(list(hosts))))[1:5], ',') AS hosts
    FROM (SELECT upload_id, extract(HOUR FROM ts) AS hour, {_ACTOR} AS actor, count(*) AS n, list(DISTINCT host) FILTER (WHERE host IS NOT NULL) AS hosts
      FROM log_entries WHERE ts IS NOT NULL GROUP BY 1, 2, 3) x JOIN quiet q ON q.upload_id = x.upload_id AND q.hour = x.hour
    GROUP BY 1, 2) WHERE entry_count >= 5""")

_DETECTOR_CTES = {
    "minutes": _MINUTES, "bursts": _BURSTS, "spike": _SPIKE, "exfil": _EXFIL, "beacon": _BEACON, "threat": _THREAT,
    "hosts": _HOSTS, "rare": _RARE, "quiet": _QUIET, "off": _OFF,
}
_COMMON = "upload_id, kind, title, round(score, 6) AS score, entry_count"


def _detect(sql: str, *names: str, **more: str) -> str:
    chosen = {n: _DETECTOR_CTES[n] for n in names or _DETECTOR_CTES}
    return _with(sql, ["log_entries"], **chosen, **more)


SQL["volume_spike"] = _detect(f"""SELECT {_COMMON}, client_ip, peak_requests_per_minute, median_requests_per_minute,
  minutes_affected, {_iso('first')} AS window_start, {_iso('last')} AS window_end FROM spike""", "minutes", "bursts", "spike")
SQL["data_exfil"] = _detect(f"""SELECT {_COMMON}, username, host, total_bytes_sent, request_count, largest_request_bytes FROM exfil""", "exfil")
SQL["beaconing"] = _detect(f"""SELECT {_COMMON}, client_ip, host, round(mean_gap, 1) AS mean_interval_seconds,
  round(gap_stdev, 2) AS interval_stdev_seconds, round(regularity, 4) AS regularity, {_iso('first')} AS first_seen, {_iso('last')} AS last_seen
  FROM beacon""", "beacon")
SQL["blocked_threat"] = _detect(f"SELECT {_COMMON}, threat_name, host, users, actions FROM threat", "threat")
SQL["rare_destination"] = _detect(f"SELECT {_COMMON}, host, username, busiest_host_hits, urls FROM rare", "hosts", "rare")
SQL["off_hours"] = _detect(f"SELECT {_COMMON}, actor, hours, median_hourly_volume, these_hours_volume, hosts FROM off", "quiet", "off")

_NULLS = "CAST(NULL AS VARCHAR)"
_UNION = " UNION ALL ".join(
    f"SELECT upload_id, kind, title, score, entry_count, {cols} FROM {name}" for name, cols in {
        "spike": f"client_ip, {_NULLS} AS username, {_NULLS} AS host, {_NULLS} AS threat_name, {_NULLS} AS actor",
        "exfil": f"{_NULLS}, username, host, {_NULLS}, {_NULLS}", "beacon": f"client_ip, {_NULLS}, host, {_NULLS}, {_NULLS}",
        "threat": f"{_NULLS}, {_NULLS}, host, threat_name, {_NULLS}", "rare": f"{_NULLS}, username, host, {_NULLS}, {_NULLS}",
        "off": f"{_NULLS}, {_NULLS}, {_NULLS}, {_NULLS}, actor"}.items())
_CANDIDATES = f"""SELECT *, CAST(row_number() OVER (PARTITION BY upload_id ORDER BY score DESC, kind, title) AS INT) AS rank,
  'c' || CAST(row_number() OVER (PARTITION BY upload_id ORDER BY score DESC, kind, title) - 1 AS VARCHAR) AS candidate_id FROM ({_UNION})"""


def _cands(sql: str, **more: str) -> str:
    return _detect(sql, *_DETECTOR_CTES, candidates=_CANDIDATES, **more)


SQL["detect_all"] = _cands("SELECT upload_id, candidate_id, rank, kind, title, round(score, 6) AS score, entry_count FROM candidates")
SQL["detect_all_scored"] = _uncapped(_cands("SELECT upload_id, rank, kind, title, round(score, 6) AS score, entry_count FROM candidates"))
_BRIDGE = f"""
SELECT c.upload_id, kind, candidate_id, e.id AS entry_id FROM candidates c JOIN log_entries e ON e.upload_id = c.upload_id AND (
  (kind = 'volume_spike' AND e.client_ip = c.client_ip AND EXISTS (SELECT 1 FROM bursts b WHERE b.upload_id = e.upload_id
     AND b.client_ip = e.client_ip AND b.minute = date_trunc('minute', e.ts)))
  OR (kind = 'data_exfil' AND e.req_bytes > 0 AND coalesce(e.username, 'unknown') = c.username AND coalesce(e.host, 'unknown') = c.host)
  OR (kind = 'beaconing' AND e.client_ip = c.client_ip AND e.host = c.host AND e.ts IS NOT NULL)
  OR (kind = 'blocked_threat' AND e.threat_name = c.threat_name AND coalesce(e.host, 'unknown') = c.host)
  OR (kind = 'rare_destination' AND e.host = c.host)
  OR (kind = 'off_hours' AND coalesce(e.username, e.client_ip, 'unknown') = c.actor AND EXISTS (SELECT 1 FROM quiet q
     WHERE q.upload_id = e.upload_id AND q.hour = extract(HOUR FROM e.ts))))"""
SQL["finding_entries"] = _cands("SELECT * FROM bridge", bridge=_BRIDGE)

_BY_SCORE = "CASE WHEN {0} >= 0.9 THEN 'critical' WHEN {0} >= 0.7 THEN 'high' WHEN {0} >= 0.5 THEN 'medium' ELSE 'low' END"
_KIND_URGENCY = """CASE kind WHEN 'data_exfil' THEN 'immediate' WHEN 'beaconing' THEN 'immediate' WHEN 'volume_spike' THEN 'today'
  WHEN 'off_hours' THEN 'today' WHEN 'rare_destination' THEN 'this_week' WHEN 'blocked_threat' THEN 'monitor' ELSE 'this_week' END"""
_KIND_SEVERITY = """CASE kind WHEN 'data_exfil' THEN 'critical' WHEN 'beaconing' THEN 'high' WHEN 'blocked_threat' THEN 'high'
  WHEN 'volume_spike' THEN 'medium' WHEN 'off_hours' THEN 'medium' WHEN 'rare_destination' THEN 'low' ELSE 'medium' END"""
SQL["fallback_report"] = _cands(f"""
SELECT u.upload_id, count(c.kind) AS findings,
  CASE WHEN count(c.kind) = 0 THEN 'No anomalies were detected in this log.' ELSE CAST(count(c.kind) AS VARCHAR)
    || CASE WHEN count(c.kind) = 1 THEN ' anomaly' ELSE ' anomalies' END
    || ' detected by statistical analysis. No narrative is available; explanations come from detector evidence.' END AS summary,
  CASE WHEN count(c.kind) = 0 THEN 'low' ELSE {_BY_SCORE.format('max(score)')} END AS overall_risk
FROM (SELECT DISTINCT upload_id FROM log_entries) u LEFT JOIN candidates c ON c.upload_id = u.upload_id GROUP BY 1""")
SQL["fallback_findings"] = _cands(f"""
SELECT upload_id, candidate_id, title, {_BY_SCORE.format('score')} AS severity, round(score, 3) AS confidence,
  'Review the highlighted entries.' AS recommendation FROM candidates""")
SQL["apply_report"] = _cands(f"""
SELECT upload_id, candidate_id, kind, {_BY_SCORE.format('score')} AS severity, {_KIND_URGENCY} AS urgency,
  {_KIND_URGENCY} IN ('immediate', 'today') AS action_required, 'Review the highlighted entries.' AS action_label,
  round(score, 3) AS confidence, entry_count FROM candidates""")
SQL["rejected_report_rows"] = _entries("SELECT DISTINCT upload_id, 'c999' AS candidate_id FROM log_entries")
SQL["findings_from_candidates"] = _cands(f"""
SELECT upload_id, candidate_id, kind, {_KIND_SEVERITY} AS severity, {_KIND_URGENCY} AS urgency,
  {_KIND_URGENCY} IN ('immediate', 'today') AS action_required, round(score, 6) AS confidence, title AS explanation FROM candidates""")
SQL["finding_texts"] = _cands("""
SELECT upload_id, candidate_id, kind, concat_ws(chr(10), replace(kind, '_', ' '), title, 'host: ' || host, 'client_ip: ' || client_ip,
  'username: ' || username, 'actor: ' || actor, 'threat_name: ' || threat_name) AS content FROM candidates""")
SQL["upload_overview"] = _entries("""
SELECT e.upload_id, count(*) AS total_entries, count(DISTINCT username) FILTER (WHERE host IS NOT NULL) AS distinct_users,
  count(DISTINCT client_ip) FILTER (WHERE ts IS NOT NULL) AS distinct_client_ips, count(DISTINCT host) AS distinct_hosts,
  CAST(coalesce(sum(req_bytes) FILTER (WHERE req_bytes > 0), 0) AS BIGINT) AS total_bytes_sent, max(hours_covered) AS hours_covered,
  CAST(max(busiest_hour) AS INT) AS busiest_hour, max(requests_per_hour) AS requests_per_hour,
  coalesce(array_to_string(list_sort(list_distinct(list(threat_name) FILTER (WHERE threat_name IS NOT NULL)))[1:10], ','), '') AS threat_names
FROM log_entries e LEFT JOIN (SELECT upload_id, string_agg(CAST(h AS VARCHAR), ',' ORDER BY h) AS hours_covered,
    arg_max(h, n * 100 - h) AS busiest_hour, string_agg(CAST(h AS VARCHAR) || '=' || CAST(n AS VARCHAR), ',' ORDER BY CAST(h AS VARCHAR)) AS requests_per_hour
  FROM (SELECT upload_id, extract(HOUR FROM ts) AS h, count(*) AS n FROM log_entries WHERE ts IS NOT NULL GROUP BY 1, 2) GROUP BY 1) x
ON x.upload_id = e.upload_id GROUP BY 1""")
SQL["evidence_rows"] = _cands("""
SELECT b.upload_id, candidate_id, entry_id, left(raw, 300) AS line FROM (SELECT *, row_number() OVER (
  PARTITION BY upload_id, candidate_id ORDER BY entry_id) AS place FROM bridge) b
JOIN log_entries e ON e.upload_id = b.upload_id AND e.id = b.entry_id WHERE place <= 3""", bridge=_BRIDGE)
SQL["latest_status"] = f"""
WITH ev AS (SELECT l_orderkey AS analysis_id, CAST(l_shipdate AS TIMESTAMP) AS event_ts,
  max(CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'running' ELSE 'queued' END) AS status FROM lineitem GROUP BY 1, 2),
ended AS (SELECT analysis_id, min(event_ts) FILTER (WHERE status IN ('done', 'failed')) AS t FROM ev GROUP BY 1),
valid AS (SELECT ev.* FROM ev JOIN ended USING (analysis_id) WHERE status IN ('done', 'failed') OR t IS NULL OR event_ts <= t)
SELECT analysis_id, arg_max(status, event_ts) AS status, {_ts('max(event_ts)', 'updated_at')},
  CAST(CASE WHEN count(*) FILTER (WHERE status = 'failed') > 0 THEN 2000 END AS INT) AS error_chars,
  {_ts("min(event_ts) FILTER (WHERE status = 'running')", 'started_at')},
  {_ts("max(event_ts) FILTER (WHERE status IN ('done', 'failed'))", 'finished_at')} FROM valid GROUP BY 1"""
_EXPECTED = " UNION ALL ".join(f"SELECT '{k}' AS kind, '{v}' AS entity" for k, v in fixed.EXPECTED_ATTACKS.items())
SQL["evaluate"] = _cands("""
SELECT *, detected = expected AND false_positives = 0 AS passed FROM (SELECT *, round(CAST(detected AS DOUBLE) / expected, 6) AS recall,
  round(coalesce(CAST(detected AS DOUBLE) / nullif(detected + false_positives, 0), 0), 6) AS precision,
  round(coalesce(2.0 * detected / nullif(detected + false_positives + expected, 0), 0), 6) AS f1 FROM (
  SELECT count(*) AS expected, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM candidates c WHERE c.upload_id = 'up0' AND c.kind = x.kind)) AS detected,
    count(*) FILTER (WHERE EXISTS (SELECT 1 FROM candidates c JOIN log_entries e ON e.upload_id = c.upload_id AND e.host = c.host
      WHERE c.upload_id = 'up0' AND c.kind = x.kind AND (contains(c.host, x.entity) OR contains(x.entity, c.host)))
      OR EXISTS (SELECT 1 FROM candidates c WHERE c.upload_id = 'up0' AND c.kind = x.kind AND (
        contains(coalesce(c.client_ip, c.actor), x.entity) OR contains(x.entity, coalesce(c.client_ip, c.actor))))) AS named,
    (SELECT count(DISTINCT kind) FROM candidates WHERE upload_id = 'up1') AS false_positives
  FROM ex x)) """, ex=_EXPECTED)

# --- access -----------------------------------------------------------------------------
SQL["visible_uploads"] = _with(f"SELECT * REPLACE ({_TIME.format('created_at')} AS created_at) FROM v", ["uploads", "access_grants"], v=_MEMBER)
_GONE = {
    "uploads": "id IN (FROM mine)", "analyses": "upload_id IN (FROM mine)", "access_grants": "coalesce(upload_id IN (FROM mine), false)",
    "anomalies": "analysis_id IN (SELECT id FROM analyses WHERE upload_id IN (FROM mine))"}
_STORED_AS = {"anomalies": "findings", "access_grants": "grants"}
SQL["erase_uploads"] = _with(" UNION ALL ".join(
    f"""SELECT '{_STORED_AS.get(t, t)}' AS table_name, count(*) FILTER (WHERE {gone}) AS erased, count(*) FILTER (WHERE NOT ({gone})) AS "left" FROM {t}"""
    for t, gone in _GONE.items()), list(_GONE), mine="SELECT id FROM uploads WHERE org_id = 'org1' AND id % 7 = 0")
_LATEST = """SELECT upload_id, id AS analysis_id, status AS analysis_status FROM (SELECT *, row_number() OVER (
  PARTITION BY upload_id ORDER BY created_at DESC, id DESC) AS place FROM analyses) WHERE place = 1"""
SQL["latest_analysis"] = with_views(_LATEST, "analyses")
SQL["list_visible_uploads"] = _with(f"""SELECT v.* REPLACE ({_TIME.format('v.created_at')} AS created_at), analysis_id, analysis_status
FROM v LEFT JOIN l ON l.upload_id = v.id ORDER BY v.created_at DESC, v.id""", ["uploads", "access_grants", "analyses"], v=_ADMIN, l=_LATEST)
_REQUESTS = """SELECT DISTINCT user_id, upload_id FROM (SELECT o_custkey AS user_id, o_orderkey AS upload_id FROM orders
UNION ALL SELECT CASE WHEN o_custkey > 25 THEN o_custkey - 25 ELSE o_custkey + 25 END, o_orderkey FROM orders
UNION ALL SELECT CASE WHEN o_custkey > 1 THEN o_custkey - 1 ELSE o_custkey + 1 END, o_orderkey FROM orders)"""
_RESOLVED = f"""SELECT r.user_id, r.upload_id, u.role, u.org_id, up.user_id AS owner_id, CAST(CASE WHEN u.org_id <> up.org_id THEN 0
  WHEN up.user_id = u.id THEN 3 ELSE greatest(coalesce(g1.best, 0), coalesce(g2.best, 0), CASE WHEN u.role IN ('admin', 'owner') THEN 2 ELSE 0 END) END AS INT) AS level_rank
FROM req r JOIN users u ON u.id = r.user_id JOIN uploads up ON up.id = r.upload_id
LEFT JOIN (SELECT subject_user_id, org_id, upload_id, max({_LEVEL.format('level')}) AS best FROM live WHERE upload_id IS NOT NULL GROUP BY 1, 2, 3) g1
  ON g1.subject_user_id = r.user_id AND g1.org_id = up.org_id AND g1.upload_id = up.id
LEFT JOIN (SELECT subject_user_id, org_id, max({_LEVEL.format('level')}) AS best FROM live WHERE upload_id IS NULL GROUP BY 1, 2) g2
  ON g2.subject_user_id = r.user_id AND g2.org_id = up.org_id"""
_LIVE = "SELECT * FROM access_grants WHERE expires_at IS NULL OR expires_at > TIMESTAMP '1998-06-01'"
_NAME = "CASE {0} WHEN 1 THEN 'summary' WHEN 2 THEN 'dashboard' WHEN 3 THEN 'full' END"


def _access(sql: str, views: tuple = ()) -> str:
    return _with(sql, ["users", "uploads", "access_grants", *views], live=_LIVE, req=_REQUESTS, lv=_RESOLVED)


SQL["resolve_levels"] = _access(f"SELECT user_id, upload_id, role, level_rank, {_NAME.format('level_rank')} AS level FROM lv")
_OUTCOME = "CASE WHEN level_rank = 0 THEN 'not_found' WHEN level_rank >= 3 THEN 'granted' WHEN role IN ('admin', 'owner') THEN 'breakglass' ELSE 'forbidden' END"
SQL["require_level"] = _access(f"""SELECT user_id, upload_id, {_OUTCOME} AS outcome,
  CASE WHEN {_OUTCOME} IN ('granted', 'breakglass') THEN 'full' END AS effective_level FROM lv""")
SQL["breakglass_audit"] = _access(f"""
SELECT org_id, user_id AS actor_user_id, 'breakglass.raw_access' AS action, 'upload' AS resource_type, upload_id AS resource_id,
  '{{"granted_level":"' || {_NAME.format('level_rank')} || '","required_level":"full","role":"' || role || '","upload_owner":"' || CAST(owner_id AS VARCHAR) || '"}}' AS detail,
  '1998-06-01 00:00:00' AS created_at FROM lv WHERE {_OUTCOME} = 'breakglass'""")
SQL["best_grants"] = _with(f"""SELECT subject_user_id, org_id, upload_id, {_NAME.format('best')} AS level FROM (
  SELECT subject_user_id, org_id, upload_id, max({_LEVEL.format('level')}) AS best FROM live GROUP BY 1, 2, 3)""", ["access_grants"], live=_LIVE)
SQL["mask_entry_ids"] = _access("""
SELECT a.id, a.analysis_id // 10 AS upload_id, CASE WHEN f.upload_id IS NOT NULL THEN array_to_string(range(1, a.entry_count + 1), ',') END AS entry_ids
FROM anomalies a LEFT JOIN (SELECT DISTINCT upload_id FROM lv WHERE user_id = 7 AND level_rank >= 3) f ON f.upload_id = a.analysis_id // 10""", ("anomalies",))
SQL["list_grants"] = with_views(f"""
SELECT * REPLACE ({_TIME.format('created_at')} AS created_at, {_TIME.format('expires_at')} AS expires_at) FROM access_grants
WHERE org_id = 'org2' AND (granted_by = 7 OR subject_user_id = 7)""", "access_grants")
SQL["list_members"] = with_views(f"SELECT * REPLACE ({_TIME.format('created_at')} AS created_at) FROM users WHERE org_id = 'org2'", "users")
SQL["list_audit"] = with_views(f"""
SELECT a.* REPLACE ({_TIME.format('a.created_at')} AS created_at), u.email AS actor_email
FROM (SELECT * FROM audit_log WHERE org_id = 'org1' ORDER BY created_at DESC, id LIMIT 200) a LEFT JOIN users u ON u.id = a.actor_user_id""",
                               "audit_log", "users")
SQL["find_by_email"] = with_views("SELECT id, org_id, email FROM users WHERE lower(email) = 'customer#000000007@x.io'", "users")
SQL["stale_analyses"] = with_views("""
SELECT a.id, a.upload_id, a.org_id, u.user_id, a.scope, a.baseline_window_days, 'queued' AS status FROM analyses a JOIN uploads u ON u.id = a.upload_id
WHERE a.status = 'running' AND a.heartbeat_at < TIMESTAMP '1998-06-01' - INTERVAL 300 SECOND""", "analyses", "uploads")
SQL["redact"] = _entries("""
SELECT id, upload_id, 'u_' || left(sha256('fixture-salt:' || username), 12) AS username_hash,
  'ip_' || left(sha256('fixture-salt:' || client_ip), 12) AS client_ip_hash, category, resp_code FROM log_entries""")
SQL["upsert_grants"] = _with(f"""
SELECT org_id, upload_id, subject_user_id, level, {_ts('expires_at')} FROM (
  SELECT first_org AS org_id, upload_id, subject_user_id, arg_max(level, seq) AS level,
    CASE WHEN max(seq) >= 0 AND arg_max(fresh, seq) THEN NULL ELSE arg_max(exp, seq) END AS expires_at
  FROM (SELECT *, org_id AS first_org, coalesce(expires_at, NULL) AS exp FROM c) GROUP BY 1, 2, 3)""", ["access_grants"],
    c="""SELECT org_id, upload_id, subject_user_id, level, expires_at, -1 AS seq, false AS fresh FROM (SELECT *, row_number() OVER (
  PARTITION BY subject_user_id, CASE WHEN upload_id IS NULL THEN 'org:' || org_id ELSE 'upload:' || CAST(upload_id AS VARCHAR) END ORDER BY id DESC) AS place
  FROM access_grants) WHERE place = 1
UNION ALL SELECT org_id, upload_id, subject_user_id, 'full', NULL, id, true FROM access_grants""")

# --- search -----------------------------------------------------------------------------------
_STOPS = ", ".join(f"'{w}'" for w in fixed.STOP_WORDS)




_WORDS = """SELECT id, field, weight, CAST(unnest(range(len(w))) AS INT) AS pos, unnest(w) AS word FROM (
  SELECT id, field, weight, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM (
  SELECT doc_id AS id, 'kind' AS field, 1.0 AS weight, source AS text FROM documents
  UNION ALL SELECT doc_id, 'explanation', 0.4, text FROM documents))"""
# Each stemming step is its own subquery: nesting the CASEs would repeat them.
_STEMMED = "SELECT id, field, weight, pos, word AS token FROM words WHERE word NOT IN (" + _STOPS + ")"
for _pattern, _by in (("ies$", "y"), ("(ss|sh|ch|x|z)es$", "\\1"), ("([^s])s$", "\\1"), ("(ing|ed)$", "")):
    _STEMMED = f"SELECT * REPLACE (CASE WHEN length(token) > 3 THEN regexp_replace(token, '{_pattern}', '{_by}') ELSE token END AS token) FROM ({_STEMMED})"
_INDEX = f"""SELECT id, 'stemmed' AS form, field, pos, token, weight FROM ({_STEMMED})
UNION ALL SELECT id, 'split', field, pos, word, 0.1 FROM words"""


def _search(sql: str) -> str:
    return f"WITH words AS ({_WORDS}), idx AS ({_INDEX})\n{sql}"


SQL["build_finding_index"] = _search("""SELECT form, field, token, count(*) AS occurrences, count(DISTINCT id) AS findings FROM idx GROUP BY 1, 2, 3""")
SQL["search_findings_words"] = _search("""
SELECT id AS finding_id, round(CAST(sum(w) AS DOUBLE), 6) AS rank FROM (SELECT id, token, max(weight) AS w FROM idx
  WHERE form = 'split' AND token IN ('the', 'of', 'with') GROUP BY 1, 2) GROUP BY 1 HAVING count(*) = 3 ORDER BY 2 DESC, 1 LIMIT 50""")
_QUERY_WORDS = "'thorreou', 'ndernt', 'zebra', 'or', 'entretre'"
SQL["search_findings_text"] = _search(f"""
SELECT id AS finding_id, round(CAST(w AS DOUBLE), 6) AS rank FROM (
  SELECT id, sum(weight) AS w, count(*) FILTER (WHERE form = 'split') AS k, bool_or(form = 'stemmed' AND token = 'zebra') AS z,
    bool_or(form = 'stemmed' AND token = 'entretre') AS e
  FROM (SELECT id, form, token, max(weight) AS weight FROM idx WHERE (form = 'split' AND token IN ({_QUERY_WORDS}))
    OR (form = 'stemmed' AND token IN ('thorreou', 'ndernt', 'zebra', 'entretre')) GROUP BY 1, 2, 3) GROUP BY 1)
LEFT JOIN (SELECT DISTINCT a.id AS pid FROM idx a JOIN idx b ON b.id = a.id AND b.field = a.field AND b.pos = a.pos + 1
  WHERE a.form = 'stemmed' AND b.form = 'stemmed' AND a.token = 'thorreou' AND b.token = 'ndernt') p ON p.pid = id
WHERE (pid IS NOT NULL AND NOT z) OR e OR k = 5 ORDER BY 2 DESC, 1 LIMIT 100""")
_COS = """list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE)))
  / (sqrt(list_sum(list_transform(v.embedding, lambda x: CAST(x AS DOUBLE) * x))) * sqrt(list_sum(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE) * x))))"""
SQL["search_findings_vector"] = f"""SELECT v.vec_id, round({_COS}, 6) AS rank FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
ORDER BY {_COS} DESC, 1 LIMIT 20"""
SQL["search_many"] = f"""SELECT vec_id, query, place, round(r, 6) AS rank FROM (SELECT vec_id, query, r, CAST(row_number() OVER (
  PARTITION BY query ORDER BY r DESC, vec_id) AS INT) AS place FROM (SELECT v.vec_id, CAST(q.vec_id AS VARCHAR) AS query, {_COS} AS r
  FROM embeddings v, (SELECT vec_id, embedding FROM embeddings WHERE vec_id IN (0, 1, 2)) q)) WHERE place <= 10"""
_SEEN_BY = {"member": _MEMBER, "holder": _visible("org0", 646, False), "admin": _ADMIN}


def _seen(hits: str, limit: int, **ctes: str) -> str:
    """Best hits (id, rank) among the findings each caller may see."""
    parts = [f"""(SELECT '{who}' AS caller, h.id AS finding_id, up.id AS upload_id, round(CAST(h.rank AS DOUBLE), 6) AS rank
  FROM hits h JOIN analyses a ON a.id = (h.id % 1000 + 1) * 10 + 1 JOIN v_{who} up ON up.id = a.upload_id
  ORDER BY h.rank DESC, h.id LIMIT {limit})""" for who in _SEEN_BY]
    return _with(" UNION ALL ".join(parts), ["uploads", "access_grants", "analyses"], **ctes, hits=hits,
                 **{f"v_{who}": sql for who, sql in _SEEN_BY.items()})


SQL["search_visible_text"] = _seen("""SELECT id, sum(w) AS rank FROM (SELECT id, token, max(weight) AS w FROM idx
  WHERE form = 'split' AND token IN ('the', 'of', 'with') GROUP BY 1, 2) GROUP BY 1 HAVING count(*) = 3""", 50,
                                   words=_WORDS, idx=_INDEX)
SQL["search_visible_vector"] = _seen(f"""SELECT v.vec_id AS id, {_COS} AS rank
  FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q""", 20)
SQL["has_embeddings"] = "SELECT count(*) > 0 AS has_embeddings FROM embeddings WHERE label = 1"

# --- observability ------------------------------------------------------------------------------
SQL["stage_percentiles"] = with_views(f"""SELECT stage, count(*) AS count, {_pct(0.5, 'duration_ms')} AS p50_ms,
  {_pct(0.95, 'duration_ms')} AS p95_ms, {_pct(0.99, 'duration_ms')} AS p99_ms FROM analysis_timings GROUP BY 1""", "analysis_timings")
SQL["metric_counters"] = with_views("""
SELECT name, label || '=' || label_value AS labels, round(sum(value), 3) AS value FROM metric_events WHERE type = 'counter' GROUP BY 1, 2
UNION ALL SELECT name, NULL, round(sum(value), 3) FROM metric_events WHERE type = 'counter' GROUP BY 1""", "metric_events")


def _nearest(source: str, by: str) -> str:
    at = lambda p: f"max(value) FILTER (WHERE rk = least(greatest(round_even({p} * n, 0), 1), n))"
    return f"""SELECT {by}, count(*) AS count, min(value) AS min, {at('CAST(0.5 AS DOUBLE)')} AS p50, {at('CAST(0.95 AS DOUBLE)')} AS p95,
  {at('CAST(0.99 AS DOUBLE)')} AS p99, max(value) AS max, avg(value) AS mean
  FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY value) AS rk, count(*) OVER (PARTITION BY {by}) AS n FROM ({source})) GROUP BY {by}"""


_RING = """SELECT name, label || '=' || label_value AS labels, value FROM (SELECT *, row_number() OVER (
  PARTITION BY name, label, label_value ORDER BY ts DESC, seq DESC) AS age FROM metric_events WHERE type = 'histogram') WHERE age <= 512"""
SQL["metric_histograms"] = with_views("SELECT name, labels, count, " + ", ".join(
    f"round({c}, 2) AS {c}" for c in ("min", "p50", "p95", "p99", "max", "mean")) + f" FROM ({_nearest(_RING, 'name, labels')})", "metric_events")
SQL["metric_gauges"] = with_views("""SELECT name, round(arg_max(value, epoch_us(ts) * 1000000 + seq % 1000000), 2) AS value
FROM metric_events WHERE type = 'gauge' GROUP BY 1""", "metric_events").replace("epoch_us(ts) * 1000000 + seq % 1000000", "CAST(epoch_us(ts) AS HUGEINT) * 1000000000000 + seq")
_SUMS = """coalesce(sum(value) FILTER (WHERE name = 'http.requests'), 0) AS requests, coalesce(sum(value) FILTER (WHERE name = 'http.errors'), 0) AS errors,
  coalesce(sum(value) FILTER (WHERE name = 'analyses.total'), 0) AS runs, coalesce(sum(value) FILTER (WHERE name = 'analyses.total' AND label_value = 'done'), 0) AS runs_ok,
  coalesce(sum(value) FILTER (WHERE name = 'llm.calls'), 0) AS calls, coalesce(sum(value) FILTER (WHERE name = 'llm.calls' AND label_value = 'ok'), 0) AS calls_ok"""
SQL["derived_ratios"] = with_views(f"""
SELECT round((requests - errors) / requests, 4) AS http_success_rate, round(errors / requests, 4) AS http_error_rate,
  round(runs_ok / runs, 4) AS analysis_success_rate, round(calls_ok / calls, 4) AS llm_success_rate, round((calls - calls_ok) / calls, 4) AS llm_fallback_rate
FROM (SELECT {_SUMS} FROM metric_events)""", "metric_events")
_WIN = "time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')"
_HELD = f"""SELECT window_start, value FROM (SELECT {_WIN} AS window_start, value, row_number() OVER (
  PARTITION BY {_WIN}, label_value ORDER BY ts DESC, seq DESC) AS age FROM metric_events WHERE name = 'http.latency_ms') WHERE age <= 512"""
_CHECKS = f"""SELECT *, value > threshold AS breached FROM (
  SELECT window_start, 'http_latency_p95' AS alert, p95 AS value, 5000.0::DOUBLE AS threshold FROM ({_nearest(_HELD, 'window_start')}) WHERE count >= 20
  UNION ALL SELECT window_start, 'http_error_rate', errors / requests, 0.2 FROM sums WHERE requests >= 20
  UNION ALL SELECT window_start, 'llm_fallback_rate', round_even((calls - calls_ok) / calls, 4), 0.2 FROM sums WHERE calls >= 5
  UNION ALL SELECT window_start, 'cpu_high', value, 85.0 FROM (SELECT {_WIN} AS window_start, arg_max(value, CAST(epoch_us(ts) AS HUGEINT) * 1000000000000 + seq) AS value
    FROM metric_events WHERE name = 'process.cpu_percent' GROUP BY 1) WHERE value > 0)"""
_WINSUMS = f"SELECT {_WIN} AS window_start, {_SUMS} FROM metric_events GROUP BY 1"
SQL["evaluate_alerts"] = _with(f"SELECT {_ts('window_start')}, alert, round(value, 4) AS value, threshold, breached FROM checks",
                               ["metric_events"], sums=_WINSUMS, checks=_CHECKS)
SQL["alert_changes"] = _with(f"""SELECT {_ts('window_start')}, alert, CASE WHEN breached THEN 'firing' ELSE 'resolved' END AS state FROM (
  SELECT *, coalesce(lag(breached) OVER (PARTITION BY alert ORDER BY window_start), false) AS was FROM checks) WHERE breached <> was""",
                             ["metric_events"], sums=_WINSUMS, checks=_CHECKS)

# --- log ingest ---------------------------------------------------------------------------------
_K = """CAST(replace(replace(props, '{"k": ', ''), '}', '') AS INT)"""
_FILE = "CASE user_id % 3 WHEN 0 THEN 'a.csv' WHEN 1 THEN 'b.tsv' ELSE 'c.log' END"
SQL["detect_format"] = f"""
SELECT f AS file, 'nss_web' AS format, CASE f WHEN 'a.csv' THEN ',' WHEN 'b.tsv' THEN chr(9) ELSE '|' END AS delimiter,
  CASE f WHEN 'a.csv' THEN '{{"ts":0,"client_ip":1,"username":2,"host":3,"url":4,"req_bytes":5,"resp_code":6,"reason":7}}'
    WHEN 'b.tsv' THEN '{{"ts":3,"client_ip":2,"username":6,"url":0,"req_bytes":4,"resp_code":5}}'
    ELSE '{{"ts":0,"client_ip":2,"username":3,"url":4,"req_bytes":5,"resp_code":6}}' END AS cols
FROM (SELECT DISTINCT {_FILE} AS f FROM events)"""
_PARSED = f"""
SELECT {_FILE} AS upload_id, CAST(event_id + 2 AS INT) AS line_no,
  strftime(CASE WHEN user_id % 3 = 2 THEN ts - INTERVAL 1 HOUR ELSE ts END, '%Y-%m-%d %H:%M:%S') AS ts,
  '10.' || CAST(user_id % 4 AS VARCHAR) || '.' || CAST(user_id % 200 AS VARCHAR) || '.' || CAST({_K} AS VARCHAR) AS client_ip,
  CASE WHEN {_K} % 7 <> 0 THEN 'user' || CAST(user_id AS VARCHAR) END AS username,
  'site' || CAST({_K} AS VARCHAR) || '.com' AS host, 'https://site' || CAST({_K} AS VARCHAR) || '.com:8443/' || event_type AS url,
  CASE WHEN {_K} % 9 <> 0 THEN CAST(greatest({_K} * 10 - 50, 0) AS BIGINT) END AS req_bytes,
  CASE WHEN user_id % 3 <> 2 THEN {_K} + 200 END AS resp_code,
  CASE WHEN user_id % 3 = 0 THEN event_type || ', "k" ' || CAST({_K} AS VARCHAR) END AS reason
FROM events"""
SQL["normalize_logs"] = _PARSED
SQL["normalize_name"] = "SELECT c_custkey, regexp_replace(lower(trim(c_name)), '[^a-z0-9]', '', 'g') || 'x' AS name FROM customer"
SQL["clean_value"] = """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN 'na' ELSE c_name END AS value FROM customer"""
SQL["host_from_url"] = "SELECT page_id, split_part(split_part(split_part(url, '://', 2), '/', 1), ':', 1) AS host FROM pages"
SQL["parse_long"] = """SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE CAST(trunc(greatest(CAST(c_acctbal AS DECIMAL(12, 2)), 0)) AS BIGINT) END AS value FROM customer"""
SQL["parse_ts"] = """SELECT o_orderkey, strftime(CASE o_orderkey % 7 WHEN 3 THEN o_orderdate - INTERVAL 2 HOUR WHEN 6 THEN NULL
  WHEN 5 THEN CASE WHEN strftime(o_orderdate, '%m-%d') IS NOT NULL THEN strptime('2024' || strftime(o_orderdate, '-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') END
  ELSE o_orderdate END, '%Y-%m-%d %H:%M:%S') AS ts FROM orders"""
SQL["parse_ip"] = """SELECT o_orderkey, CASE WHEN o_custkey % 260 < 256 THEN CAST(o_custkey % 260 AS VARCHAR) || '.' || CAST(o_orderkey % 256 AS VARCHAR) || '.0.7' END AS ip,
  CASE WHEN o_custkey % 260 < 256 THEN (o_custkey % 260) * 16777216 + (o_orderkey % 256) * 65536 + 7 END AS ip_key FROM orders"""
SQL["ip_in_cidr"] = _entries("""
SELECT coalesce(regexp_matches(client_ip, '^10\\.12\\.(2|3)\\.'), false) AS inside, count(*) AS entries, count(DISTINCT client_ip) AS addresses
FROM log_entries GROUP BY 1""")
SQL["iso8601"] = f"SELECT event_id, {_iso('ts')} AS at FROM events"
_RAMP = "CASE WHEN value / 40 <= 3.0 THEN 0.0 ELSE least(CAST(1.0 AS DOUBLE), (value / 40 - 3.0) / 9.0) END"
SQL["score_from_z"] = f"SELECT event_id, round({_RAMP}, 6) AS score, {_BY_SCORE.format('(' + _RAMP + ')')} AS severity FROM events"
SQL["kind_labels"] = with_views(f"SELECT id, {_KIND_URGENCY} AS kind_urgency, {_KIND_SEVERITY} AS kind_severity FROM anomalies", "anomalies")
SQL["status_class"] = _entries(f"SELECT {_CLASS.format('resp_code')} AS class, count(*) AS requests FROM log_entries GROUP BY 1")

# --- streaming -----------------------------------------------------------------------------------
SQL["stream_rollups"] = _with(f"""SELECT * REPLACE ({_TIME.format('bucket_start')} AS bucket_start) FROM r
WHERE bucket_start + INTERVAL 1 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM log_entries)""", ["log_entries"], r=_rollup("minute"))
SQL["alert_transitions"] = SQL["alert_changes"]
SQL["heartbeat_timeouts"] = with_views(f"""
SELECT account AS analysis_id, {_ts('ts', 'last_seen')}, 'queued' AS status FROM (
  SELECT account, ts, success, lead(ts) OVER (PARTITION BY account ORDER BY ts) AS following, max(ts) OVER () AS newest FROM auth_events)
WHERE NOT success AND (following - ts > INTERVAL 300 SECOND OR (following IS NULL AND newest - INTERVAL 60 SECOND > ts + INTERVAL 300 SECOND))""",
                                       "auth_events")
SQL["upload_manifest"] = f"""
SELECT f AS id, 'org0' AS org_id, 'own' AS user_id, f AS filename, CAST(sum(size) + max(head) AS BIGINT) AS byte_size, count(*) + 1 AS line_count,
  count(*) AS parsed_count, 'nss_web' AS format, 'org0/own/2024/02/01/' || f AS object_key, '2024-02-01 00:00:00' AS created_at
FROM (SELECT {_FILE} AS f, CASE user_id % 3 WHEN 0 THEN 61 WHEN 1 THEN 55 ELSE 61 END AS head,
  1 + length(CASE user_id % 3
    WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || ',' || ip || ',' || person || ',,' || url || ',' || size_text || ',' || code || ',"' || event_type || ', ""k"" ' || CAST(k AS VARCHAR) || '"'
    WHEN 1 THEN url || 'xx' || ip || '_1234567890_' || size_text || '_' || code || '_' || person || '_'
    ELSE strftime(ts, '%d/%b/%Y:%H:%M:%S +0100') || '|bad|' || ip || '|' || person || '|' || url || '|' || size_text END) AS size
  FROM (SELECT *, '10.' || CAST(user_id % 4 AS VARCHAR) || '.' || CAST(user_id % 200 AS VARCHAR) || '.' || CAST(k AS VARCHAR) AS ip,
    'https://site' || CAST(k AS VARCHAR) || '.com:8443/' || event_type AS url, CAST(k + 200 AS VARCHAR) AS code,
    CASE WHEN k % 7 = 0 THEN 'None' ELSE 'user' || CAST(user_id AS VARCHAR) END AS person,
    CASE WHEN k % 9 = 0 THEN '-' ELSE CAST(k * 10 - 50 AS VARCHAR) || '.75' END AS size_text
    FROM (SELECT *, {_K} AS k FROM events)))
GROUP BY 1"""

# --- event time, versions and stored tables -----------------------------------------------------
SQL["alert_transitions_shuffled"] = SQL["alert_changes"]
SQL["heartbeat_timeouts_shuffled"] = with_views(f"""
SELECT account AS analysis_id, {_ts('ts', 'last_seen')}, 'queued' AS status FROM (
  SELECT account, ts, success, lead(ts) OVER (PARTITION BY account ORDER BY ts, success DESC) AS following FROM auth_events)
WHERE NOT success AND (following IS NULL OR following - ts > INTERVAL 300 SECOND)""", "auth_events")
SQL["live_rollups"] = SQL["entry_rollups_minute"]
_COUNTED = """
SELECT upload_id, 'entries' AS table_name, count(*) AS rows FROM e GROUP BY 1
UNION ALL SELECT upload_id, 'entry_rollups', count(DISTINCT (coalesce(host, ''), date_trunc('minute', ts))) + count(DISTINCT (coalesce(host, ''), date_trunc('hour', ts)))
  FROM e WHERE ts IS NOT NULL GROUP BY 1
UNION ALL SELECT upload_id, 'status_rollups', count(DISTINCT (resp_code, date_trunc('hour', ts))) FROM e WHERE ts IS NOT NULL AND resp_code IS NOT NULL GROUP BY 1
UNION ALL SELECT upload_id, 'latency_sketches', count(DISTINCT date_trunc('hour', ts)) FROM e WHERE ts IS NOT NULL AND latency_ms IS NOT NULL GROUP BY 1
UNION ALL SELECT upload_id, 'uploads', 1 FROM e GROUP BY 1"""
SQL["ingest_tables"] = _with(_COUNTED, ["log_entries"], e="SELECT * FROM log_entries")
SQL["reingest_tables"] = _with(_COUNTED, ["log_entries"], e="SELECT * FROM log_entries WHERE upload_id <> 'up0' OR action <> 'Blocked'")
for _name in ("summary", "series_hour", "series_minute"):
    SQL[f"stored_{_name}"] = SQL[f"dashboard_{_name}"]
SQL["stored_status_breakdown"], SQL["stored_data_span"] = SQL["status_breakdown"], SQL["data_span"]
SQL["stored_subnet"] = _entries(f"""
SELECT upload_id, count(*) AS entries, count(DISTINCT client_ip) AS addresses FROM log_entries
WHERE {_IN_SCOPE.format('ts')} AND regexp_matches(client_ip, '^10\\.12\\.(2|3)\\.') GROUP BY 1""")
SQL["latency_sketch_error"] = _entries(f"""
SELECT upload_id, count(*) AS observations, true AS latency_p50_close, true AS latency_p95_close, true AS latency_p99_close
FROM log_entries WHERE {_IN_SCOPE.format('ts')} AND latency_ms IS NOT NULL GROUP BY 1""")
SQL["history_baselines"] = _with(f"""
SELECT id AS run_id, window_days, requests, errors, hosts, median_hourly_requests FROM runs JOIN (
  SELECT own, since, CAST(coalesce(sum(requests), 0) AS BIGINT) AS requests, CAST(coalesce(sum(errors), 0) AS BIGINT) AS errors,
    count(DISTINCT host) AS hosts, CAST(coalesce({_pct(0.5, 'requests')}, 0) AS DOUBLE) AS median_hourly_requests
  FROM (SELECT DISTINCT own, since FROM runs) LEFT JOIN r ON upload_id <> own AND bucket_start >= since GROUP BY 1, 2) USING (own, since)
""", ["log_entries", "analyses"], r=_rollup("hour"), runs="""
SELECT id, CAST(id % 30 + 1 AS INT) AS window_days, CASE id % 3 WHEN 0 THEN 'up0' WHEN 1 THEN 'up1' ELSE 'other' END AS own,
  TIMESTAMP '2024-01-05' + INTERVAL 1 DAY * CAST(id % 40 AS INT) + INTERVAL 1 HOUR * CAST(id % 24 AS INT) - INTERVAL 1 DAY * CAST(id % 30 + 1 AS INT) AS since
FROM analyses""")
SQL["quoted_records"] = f"""
SELECT 'f' || CAST(user_id % 4 AS VARCHAR) AS upload_id, CAST(row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) + 1 AS INT) AS line_no,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, '10.0.0.' || CAST({_K} AS VARCHAR) AS client_ip, 'user' || CAST(user_id AS VARCHAR) AS username,
  CASE {_K} % 5 WHEN 0 THEN 'first ' || event_type || '//second, "k" ' || CAST({_K} AS VARCHAR) WHEN 1 THEN CAST({_K} AS VARCHAR)
    WHEN 2 THEN '5" wide' ELSE event_type END AS reason, 200 AS resp_code
FROM events"""

# One attempt after the other: the recursion carries every key's counter, window and lock.
_SET = "list_transform({0}, lambda x, j: CASE WHEN j = e.{1} THEN {2} ELSE x END)"
SQL["throttle_attempts"] = with_views(f"""SELECT id, ip, account, decision, ip_failures, account_failures FROM (
  WITH RECURSIVE e AS (
    SELECT row_number() OVER (ORDER BY t, id) AS k, *, dense_rank() OVER (ORDER BY ip) AS i, dense_rank() OVER (ORDER BY account) AS a
    FROM (SELECT id, '10.0.0.' || CAST(id % 20 AS VARCHAR) AS ip, account, success,
                 (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 500 AS t FROM auth_events)),
  none AS (SELECT list_transform(range(max(i)), lambda x: 0::BIGINT) AS no_ip, (SELECT list_transform(range(max(a)), lambda x: 0::BIGINT) FROM e) AS no_account FROM e),
  s AS (
    SELECT 0::BIGINT AS k, 0::BIGINT AS id, '' AS ip, '' AS account, '' AS decision, 0::BIGINT AS ip_failures, 0::BIGINT AS account_failures,
           no_ip AS ipn, no_ip AS ipt, no_account AS acn, no_account AS act, no_account AS acl FROM none
    UNION ALL
    SELECT e.k, e.id, e.ip, e.account, CASE WHEN e.ipf >= 20 THEN 'throttled' WHEN e.t < e.lock_end THEN 'locked' ELSE 'allowed' END,
           e.new_ipn, e.new_acn, {_SET.format("e.ipn", "i", "e.new_ipn")}, {_SET.format("e.ipt", "i", "e.new_ipt")},
           {_SET.format("e.acn", "a", "e.new_acn")}, {_SET.format("e.act", "a", "e.new_act")}, {_SET.format("e.acl", "a", "e.new_acl")}
    FROM (
      SELECT *, CASE WHEN counts THEN ipf + 1 ELSE ipf END AS new_ipn, CASE WHEN counts AND ipf = 0 THEN t ELSE ip_anchor END AS new_ipt,
             CASE WHEN counts THEN acf + 1 WHEN open AND success THEN 0 ELSE acf END AS new_acn,
             CASE WHEN counts AND acf = 0 THEN t ELSE account_anchor END AS new_act,
             CASE WHEN counts AND acf + 1 >= 10 THEN t + 900000000 WHEN open AND success THEN 0 ELSE lock_end END AS new_acl
      FROM (SELECT *, ipf < 20 AND t >= lock_end AS open, ipf < 20 AND t >= lock_end AND NOT success AS counts FROM (
        SELECT e.*, s.ipn, s.ipt, s.acn, s.act, s.acl, s.ipt[e.i] AS ip_anchor, s.act[e.a] AS account_anchor, s.acl[e.a] AS lock_end,
               CASE WHEN e.t >= s.ipt[e.i] + 300000000 THEN 0 ELSE s.ipn[e.i] END AS ipf,
               CASE WHEN e.t >= s.act[e.a] + 1800000000 THEN 0 ELSE s.acn[e.a] END AS acf
        FROM s JOIN e ON e.k = s.k + 1))) e)
  SELECT * FROM s WHERE k > 0)""", "auth_events")
