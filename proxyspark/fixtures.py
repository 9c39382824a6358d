"""Views over the test tables, in SQL both engines evaluate alike.

``views(dialect)`` gives name -> SELECT. Traffic, tenancy, runs and findings
are all derived from whole tables; six seeded attack patterns are added to the
traffic so that every detector has something to find. ``up1`` stays benign.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proxyspark.session import pin, shared_dir
from proxyspark.sources import tables
from proxyspark.streaming.rollups import run_available

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

_K = """CAST(replace(replace(props, '{"k": ', ''), '}', '') AS INT)"""
_BASE = "SELECT *, " + _K + " AS k FROM events"

# Night hours are folded into 08..18 h so that 03 h is quiet in every upload.
_LOG_ENTRIES = """
SELECT event_id AS id,
  CASE WHEN user_id % 3 = 0 THEN 'up1' ELSE 'up0' END AS upload_id,
  'org0' AS org_id,
  CASE WHEN user_id % 3 = 0 THEN 'own1' ELSE 'own0' END AS user_id,
  CAST(event_id + 2 AS INT) AS line_no,
  CAST(ts + INTERVAL '1' HOUR * CAST(8 + extract(HOUR FROM ts) % 11 - extract(HOUR FROM ts) AS INT) AS TIMESTAMP) AS ts,
  CASE WHEN user_id % 17 = 0 THEN NULL ELSE '10.12.' || CAST(user_id % 4 AS STRING) || '.' || CAST(user_id % 250 AS STRING) END AS client_ip,
  CASE WHEN user_id % 13 = 0 THEN NULL ELSE 'user' || CAST(user_id AS STRING) END AS username,
  'site' || CAST(k % 25 AS STRING) || '.com' AS host,
  'https://site' || CAST(k % 25 AS STRING) || '.com/' || event_type AS url,
  event_type AS category,
  CASE WHEN event_type = 'error' AND user_id % 3 <> 0 AND k < 5 THEN 'Blocked' ELSE 'Allowed' END AS action,
  CAST(floor(value * 10) AS BIGINT) AS req_bytes,
  CAST(k * 1000 AS BIGINT) AS resp_bytes,
  CASE WHEN event_type = 'error' AND user_id % 3 <> 0 AND k < 5 THEN 'Threat.' || CAST(k AS STRING) END AS threat_name,
  CASE event_type WHEN 'error' THEN 400 + k % 5 WHEN 'purchase' THEN CASE WHEN k < 7 THEN 502 ELSE 201 END WHEN 'view' THEN 304 ELSE 200 END AS resp_code,
  'GET' AS method,
  CASE WHEN k % 10 = 0 THEN NULL ELSE CAST(floor(value) AS INT) END AS latency_ms,
  CASE WHEN event_type = 'signup' THEN NULL WHEN k % 3 = 0 THEN 'TCP_HIT' ELSE 'TCP_MISS' END AS cache_status,
  CASE event_type WHEN 'error' THEN 'Reason ' || CAST(k % 3 AS STRING) END AS reason,
  'event ' || CAST(event_id AS STRING) || ' ' || event_type AS raw
FROM (""" + _BASE + """) AS base
"""

# (first id, rows, start, seconds after start, ip, user, host, path, category,
#  action, req_bytes, resp_bytes, threat, code, method, latency, reason)
_ATTACKS = [
    (100000000, 600, "2024-01-15 14:22:00", "i % 180", "10.12.4.102", "s.patel",
     "internal-api.partner-portal.io", "v1", "Business", "Allowed", "280", "1400", None, 200, "GET", 40, None),
    (100001000, 12, "2024-01-15 17:12:00", "i * 180 + (i * 37) % 90", "10.12.7.88", "m.chen",
     "files.dropzone-sync.ru", "upload", "File Host", "Allowed", "18000000 + i * 500000", "500", None, 200, "POST", 900, None),
    (100002000, 300, "2024-01-15 09:00:00", "i * 60 + i % 2", "10.12.4.55", "j.okafor",
     "cdn-telemetry-sync.net", "v1/ping", "Uncategorized", "Allowed", "412", "138", None, 200, "GET", 20, None),
    (100003000, 18, "2024-01-15 03:08:00", "i * 120 + (i * 29) % 80", "10.12.7.23", "d.kim",
     "admin.crm-internal.com", "export", "Business", "Allowed", "390", "80000", None, 200, "GET", 60, None),
    (100004000, 1, "2024-01-15 16:44:00", "i", "10.12.4.31", "a.rivera",
     "paste-anon-share.onion.ly", "raw", "Uncategorized", "Allowed", "520", "8400", None, 200, "GET", 70, None),
    (100005000, 3, "2024-01-15 11:05:00", "i * 420", "10.12.9.14", "l.novak",
     "malware-delivery.tk", "payload", "Malware", "Blocked", "340", "0", "Win32.Trojan.Emotet", 403, "GET", 5,
     "Blocked - Malicious Content"),
]


def _text(value):
    return "CAST(NULL AS STRING)" if value is None else f"'{value}'"


def _attack(a, single=""):
    (first, rows, start, after, ip, user, host, path, category, action, sent, received,
     threat, code, method, latency, reason) = a
    return f"""SELECT CAST({first} + i AS BIGINT), 'up0', 'org0', 'own0', CAST({first} + i AS INT),
  CAST('{start}' AS TIMESTAMP) + INTERVAL '1' SECOND * CAST({after} AS INT),
  '{ip}', '{user}', '{host}', 'https://{host}/{path}', '{category}', '{action}',
  CAST({sent} AS BIGINT), CAST({received} AS BIGINT), {_text(threat)}, {code}, '{method}', {latency}, 'TCP_MISS',
  {_text(reason)}, 'seed ' || CAST({first} + i AS STRING) FROM range(0, {rows}, 1{single}) AS t(i)"""


def _log_entries(single):
    return _LOG_ENTRIES + "".join(f"UNION ALL {_attack(a, single)}\n" for a in _ATTACKS)


_VIEWS = {
    "log_entries": _log_entries(", 1"),  # Spark: one partition per seeded pattern
    "users": """
SELECT c_custkey AS id, 'org' || CAST(c_nationkey % 5 AS STRING) AS org_id, lower(c_name) || '@x.io' AS email,
  CASE c_custkey % 10 WHEN 0 THEN 'owner' WHEN 1 THEN 'admin' ELSE 'member' END AS role,
  CAST('2023-01-01' AS TIMESTAMP) + INTERVAL '1' MINUTE * CAST(c_custkey AS INT) AS created_at
FROM customer""",
    "uploads": """
SELECT o_orderkey AS id, 'org' || CAST(c_nationkey % 5 AS STRING) AS org_id, o_custkey AS user_id,
  'f' || CAST(o_orderkey AS STRING) || '.log' AS filename,
  CAST(floor(o_totalprice) AS BIGINT) AS byte_size, CAST(o_orderdate AS TIMESTAMP) AS created_at
FROM orders JOIN customer ON c_custkey = o_custkey""",
    "analyses": """
SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS upload_id,
  'org' || CAST(max(c_nationkey) % 5 AS STRING) AS org_id,
  CAST(max(l_shipdate) AS TIMESTAMP) + INTERVAL '1' MINUTE * CAST(l_linenumber AS INT) AS created_at,
  CASE min(l_returnflag) WHEN 'R' THEN 'failed' WHEN 'A' THEN 'running' ELSE 'done' END AS status,
  CASE l_linenumber % 2 WHEN 0 THEN 'file' ELSE 'history' END AS scope,
  CASE l_linenumber % 2 WHEN 0 THEN NULL ELSE 30 END AS baseline_window_days,
  CAST(max(l_shipdate) AS TIMESTAMP) + INTERVAL '1' SECOND * CAST(max(l_quantity) * 10 AS INT) AS heartbeat_at
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
GROUP BY l_orderkey, l_linenumber""",
    "anomalies": """
SELECT l_orderkey * 10 + l_linenumber AS analysis_id,
  (l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey AS id,
  CASE l_partkey % 6 WHEN 0 THEN 'volume_spike' WHEN 1 THEN 'data_exfil' WHEN 2 THEN 'beaconing' WHEN 3 THEN 'blocked_threat' WHEN 4 THEN 'rare_destination' ELSE 'off_hours' END AS kind,
  CASE CAST(l_quantity AS INT) % 5 WHEN 0 THEN 'info' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' ELSE 'critical' END AS severity,
  CASE l_suppkey % 4 WHEN 0 THEN 'monitor' WHEN 1 THEN 'this_week' WHEN 2 THEN 'today' ELSE 'immediate' END AS urgency,
  CAST(l_discount * 10 AS DOUBLE) AS confidence, CAST(l_linenumber AS BIGINT) AS entry_count
FROM lineitem""",
    "access_grants": """
SELECT o_orderkey AS id, 'org' || CAST(c_nationkey % 5 AS STRING) AS org_id,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_orderkey END AS upload_id,
  CASE WHEN o_custkey > 25 THEN o_custkey - 25 ELSE o_custkey + 25 END AS subject_user_id,
  CASE o_orderkey % 3 WHEN 0 THEN 'summary' WHEN 1 THEN 'dashboard' ELSE 'full' END AS level,
  o_custkey AS granted_by,
  CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderdate AS TIMESTAMP) END AS expires_at,
  CAST(o_orderdate AS TIMESTAMP) AS created_at
FROM orders JOIN customer ON c_custkey = o_custkey""",
    "audit_log": """
SELECT event_id AS id, 'org' || CAST(user_id % 5 AS STRING) AS org_id, user_id AS actor_user_id,
  event_type AS action, 'upload' AS resource_type, event_id % 1000 AS resource_id, props AS detail,
  CAST(ts AS TIMESTAMP) AS created_at
FROM events""",
    "analysis_timings": """
SELECT event_id AS id, 'org' || CAST(user_id % 5 AS STRING) AS org_id, user_id, event_type AS stage,
  value AS duration_ms, CAST(ts AS TIMESTAMP) AS created_at
FROM events""",
    "metric_events": """
SELECT event_id AS seq, CAST(ts AS TIMESTAMP) AS ts, 'http.requests' AS name, 'counter' AS type,
  'route' AS label, event_type AS label_value, CAST(1.0 AS DOUBLE) AS value FROM events
UNION ALL SELECT event_id, CAST(ts AS TIMESTAMP), 'http.errors', 'counter', 'route', event_type,
  CASE event_type WHEN 'error' THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END FROM events
UNION ALL SELECT event_id, CAST(ts AS TIMESTAMP), 'http.latency_ms', 'histogram', 'route', event_type, value * 20 FROM events
UNION ALL SELECT event_id, CAST(ts AS TIMESTAMP), 'llm.calls', 'counter', 'outcome',
  CASE WHEN user_id % 4 = 0 THEN 'error' ELSE 'ok' END, CAST(1.0 AS DOUBLE) FROM events
UNION ALL SELECT event_id, CAST(ts AS TIMESTAMP), 'analyses.total', 'counter', 'outcome',
  CASE WHEN user_id % 7 = 0 THEN 'failed' ELSE 'done' END, CAST(1.0 AS DOUBLE) FROM events
UNION ALL SELECT event_id, CAST(ts AS TIMESTAMP), 'process.cpu_percent', 'gauge', 'host',
  'w' || CAST(user_id % 4 AS STRING), value / 4 FROM events""",
    "auth_events": """
SELECT event_id AS id, CAST(ts AS TIMESTAMP) AS ts, '10.0.0.' || CAST(user_id % 20 AS STRING) AS ip,
  'user' || CAST(user_id % 40 AS STRING) || '@x.io' AS account,
  CASE WHEN event_type = 'purchase' THEN true ELSE false END AS success
FROM events""",
}


def views(dialect: str = "spark") -> dict[str, str]:
    if dialect == "spark":
        return dict(_VIEWS)
    plain = {**_VIEWS, "log_entries": _log_entries("")}
    return {k: v.replace("AS STRING)", "AS VARCHAR)") for k, v in plain.items()}


def with_views(sql: str, *names: str) -> str:
    """Prefix DuckDB SQL with the views it reads."""
    found = views("duckdb")
    return "WITH " + ",\n".join(f"{n} AS ({found[n]})" for n in names) + "\n" + sql


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or derived view as a DataFrame, straight from Parquet."""
    pin(spark)
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for table in TABLES:
        if table in _VIEWS[name]:
            load(spark, sf_dir, table).createOrReplaceTempView(table)
    return spark.sql(_VIEWS[name])


_STORED: dict[tuple, str] = {}


#: Used only where the session names no ``spark.checkpoint.dir`` (tests).
DEFAULT_FOLDER = "/tmp/checkpoints"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark, DEFAULT_FOLDER)}/proxyspark-{uuid.uuid4().hex}/{name}"


def stored(spark: SparkSession, sf_dir: str, name: str, write) -> DataFrame:
    """An interim table in the shared folder, written once per application by
    ``write(path)`` and then read with pruning like any stored table."""
    pin(spark)
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        path = scratch(spark, name)
        write(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def stored_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``log_entries`` as an ingested table."""
    return stored(spark, sf_dir, "entries", lambda path: tables.write_entries(
        load(spark, sf_dir, "log_entries"), path, buckets=4))


def stored_root(spark: SparkSession, sf_dir: str) -> str:
    """``log_entries`` ingested as versioned tables; the root they lie under."""
    from proxyspark.plans import ingest  # builds on the tables' module

    key = (spark.sparkContext.applicationId, sf_dir, "root")
    if key not in _STORED:
        root = scratch(spark, "root")
        entries = stored_entries(spark, sf_dir)
        ingest.store(spark, root, entries, manifest_of(entries), "first", 4)
        _STORED[key] = root
    return _STORED[key]


def manifest_of(entries: DataFrame) -> DataFrame:
    """What a job knows of the files behind some entries."""
    return entries.groupBy("upload_id", "org_id", "user_id").agg(
        F.min("ts").alias("created_at"), F.sum(F.length("raw") + 1).alias("byte_size")).select(
        "upload_id", "org_id", "user_id", F.concat("upload_id", F.lit(".log")).alias("filename"), "byte_size",
        F.lit("nss_web").alias("format"), F.concat_ws("/", "org_id", "user_id", "upload_id").alias("object_key"), "created_at")


def run_stream(spark: SparkSession, sf_dir: str, name: str, source: DataFrame, build,
               batches: int = 0, closing: DataFrame | None = None) -> DataFrame:
    """Write ``source`` as files, run the stream ``build`` makes of them until
    nothing is left, and read what it wrote.

    With ``batches`` the rows are dealt at random over so many files, each a
    micro-batch of its own, and ``closing`` comes last.
    """
    def fill(path):
        if not batches:
            source.write.parquet(path)
            return
        source.repartition(batches, F.rand(7)).write.parquet(path)
        closing.coalesce(1).write.mode("append").parquet(path)

    feed = stored(spark, sf_dir, f"{name}_feed", fill)

    def run(path):
        # One state store per shuffle partition, and no more than there are cores.
        usual = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", str(min(int(usual), spark.sparkContext.defaultParallelism)))
        try:
            place = _STORED[(spark.sparkContext.applicationId, sf_dir, f"{name}_feed")]
            reader = spark.readStream.schema(feed.schema)
            files = (reader.option("maxFilesPerTrigger", 1) if batches else reader).parquet(place)
            run_available(build(files), path, f"{path}_checkpoint")
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", usual)

    return stored(spark, sf_dir, name, run)
