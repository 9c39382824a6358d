"""Fixed values.

Everything here must equal the published behaviour for results to agree:
names, thresholds, orderings and lookup tables. No logic lives in this file.
"""

# --- enum orders, lowest first ------------------------------------------------
ACCESS_LEVELS = ["summary", "dashboard", "full"]
ORG_ROLES = ["member", "admin", "owner"]
SEVERITIES = ["info", "low", "medium", "high", "critical"]
URGENCIES = ["monitor", "this_week", "today", "immediate"]
ANALYSIS_STATUSES = ["queued", "running", "done", "failed"]
ANALYSIS_SCOPES = ["file", "history"]
GRAINS = ["minute", "hour"]

# --- log files -----------------------------------------------------------------
LOG_SUFFIXES = [".log", ".txt", ".csv", ".tsv"]
ABSENT_MARKERS = ["", "-", "None", "NA", "N/A"]
MIN_KNOWN_HEADERS = 2
EPOCH_MILLIS_ABOVE = 1_000_000_000_000
# seconds that still fit a timestamp, which counts microseconds in 64 bits
EPOCH_SECONDS_WITHIN = 9_223_372_036_854

# canonical field -> header spellings, best first (lower-case alphanumerics)
FIELD_ALIASES = {
    "ts": ["datetime", "eventtime", "time", "timestamp", "date", "logtime"],
    "client_ip": ["clientip", "clientinternalip", "cip", "clientpublicip", "srcip"],
    "username": ["login", "user", "username", "userid"],
    "host": ["host", "hostname", "serverhost"],
    "url": ["url", "requesturl", "uri"],
    "category": ["urlcategory", "urlsupercategory", "urlclass", "category"],
    "action": ["action", "eventaction", "policyaction"],
    "req_bytes": ["requestsize", "reqsize", "sentbytes", "bytesout"],
    "resp_bytes": ["responsesize", "respsize", "receivedbytes", "bytesin"],
    "user_agent": ["useragent", "useragentheader", "ua"],
    "threat_name": ["threatname", "malwarename", "threat", "virusname"],
    "resp_code": ["respcode", "statuscode", "status", "httpstatus"],
    "latency_ms": ["totaltime", "requesttime", "responsetime", "duration", "timetaken"],
    "method": ["requestmethod", "method", "httpmethod"],
    "cache_status": ["cachehit", "tcpstatus", "cachestatus", "cached"],
    "reason": ["reason", "statusreason", "blockreason", "policyreason"],
}

# timestamp layouts, tried in this order
_CLOCK = r"\d{1,2}:\d{2}:\d{2}(?:[.,]\d+)?"
TIMESTAMP_SHAPES = {
    "iso": rf"^\d{{4}}-\d{{2}}-\d{{2}}(?: {_CLOCK}|T{_CLOCK}(?:Z|[+-]\d{{2}}:\d{{2}})?)$",
    "epoch": r"^[+-]?\d+$",
    "slashes": rf"^\d{{4}}/\d{{2}}/\d{{2}} {_CLOCK}$",
    "access_log": r"^\d{2}/[A-Za-z]{3}/\d{4}:",
    "yearless": r"^[A-Za-z]{3}\s",
}
ACCESS_LOG_PATTERN = "dd/MMM/yyyy:H:mm:ss[.SSSSSSSSS] xx"
YEARLESS_PATTERN = "yyyy MMM d H:mm:ss[.SSSSSSSSS]"

# --- detectors -------------------------------------------------------------------
MIN_SCORE = 0.30
MAX_PER_DETECTOR = 5
MAD_SCALE = 1.4826
IDENTICAL_SPREAD_Z = 50.0
MIN_SPIKE_BUCKETS = 5
MIN_BURST_REQUESTS = 20
SPIKE_FLAG_Z, SPIKE_CERTAIN_Z = 3.0, 10.0
MIN_EXFIL_ROWS = 10
EXFIL_FLAG_Z, EXFIL_CERTAIN_Z = 3.0, 7.0
MIN_BEACON_HITS = 12
BEACON_MEAN_SECONDS = (5, 86400)
BEACON_MIN_REGULARITY = 0.80
BEACON_REGULARITY_SPAN = 0.18
THREAT_SCORE = 0.95
MIN_RARE_HOSTS = 5
RARE_MAX_HITS = 3
MIN_HOURS_SEEN = 4
QUIET_HOUR_RATIO = 0.15
MIN_OFF_HOURS_REQUESTS = 5
OFF_HOURS_FULL_REQUESTS = 10
UNKNOWN = "unknown"

TITLES = {
    "volume_spike": "Request burst from %s",
    "data_exfil": "Large outbound transfer: %s → %s",
    "beaconing": "Periodic check-in: %s → %s",
    "blocked_threat": "%s at %s",
    "rare_destination": "Rarely-seen destination: %s",
    "off_hours": "Off-hours activity: %s",
}

# --- findings --------------------------------------------------------------------
URGENCY_BY_KIND = {
    "data_exfil": "immediate",
    "beaconing": "immediate",
    "volume_spike": "today",
    "off_hours": "today",
    "rare_destination": "this_week",
    "blocked_threat": "monitor",
}
SEVERITY_BY_KIND = {
    "data_exfil": "critical",
    "beaconing": "high",
    "blocked_threat": "high",
    "volume_spike": "medium",
    "off_hours": "medium",
    "rare_destination": "low",
}
DEFAULT_URGENCY = "this_week"
DEFAULT_SEVERITY = "medium"
ACTION_URGENCIES = ["immediate", "today"]
# score floor -> severity, highest first; anything lower is "low"
SEVERITY_FLOORS = [(0.9, "critical"), (0.7, "high"), (0.5, "medium")]
ACTION_LABEL_CHARS = 120
ERROR_CHARS = 2000
PACKET_CHARS = 14_000
SAMPLE_ROWS = 3
SAMPLE_CHARS = 300
OVERVIEW_THREATS = 10
RARE_EVIDENCE_URLS = 3
OFF_HOURS_EVIDENCE_HOSTS = 5
ENTITY_FIELDS = ["host", "client_ip", "actor", "username", "threat_name"]
FINDING_TEXT_FIELDS = ["host", "client_ip", "username", "actor", "threat_name"]
EMBED_CHARS = 8000
EMBED_DIMS = 1024

# --- dashboards --------------------------------------------------------------------
DEFAULT_WINDOW_DAYS = 30
BASELINE_DEFAULT_DAYS = 30
BASELINE_MAX_DAYS = 365
TOP_DIMENSIONS = {
    "host": "host",
    "url": "url",
    "user": "username",
    "ip": "client_ip",
    "category": "category",
}
TOP_LIMIT = (10, 100)
SEARCH_LIMIT = (20, 100)
ACTION_LIMIT = (25, 100)
AUDIT_LIMIT = (50, 200)
PAGE_SIZE = 25
TIMELINE_MINUTES = 15

# --- search ------------------------------------------------------------------------
SEARCH_WEIGHTS = {"kind": 1.0, "explanation": 0.4, "recommendation": 0.2}
SPLIT_WEIGHT = 0.1
QUERY_CHARS = 500
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he "
    "him his himself she her hers herself it its itself they them their theirs "
    "themselves what which who whom this that these those am is are was were be "
    "been being have has had having do does did doing a an the and but if or "
    "because as until while of at by for with about against between into through "
    "during before after above below to from up down in out on off over under "
    "again further then once here there when where why how all any both each few "
    "more most other some such no nor not only own same so than too very s t can "
    "will just don should now"
).split()

# --- privacy, access, operations -----------------------------------------------------
FORBIDDEN_FIELDS = [
    "raw", "url", "username", "user_agent", "client_ip", "host", "password",
    "password_hash", "referer", "query",
]
HASH_CHARS = 12
STALE_SECONDS = 300
HISTOGRAM_RING = 512
MIN_ALERT_SAMPLES = 20
MIN_ALERT_CALLS = 5
ALERT_THRESHOLDS = {
    "http_latency_p95": 5000.0,
    "http_error_rate": 0.05,
    "cpu_high": 85.0,
    "llm_fallback_rate": 0.20,
}
IP_FAILURES, IP_WINDOW_SECONDS = 20, 300
ACCOUNT_FAILURES, ACCOUNT_WINDOW_SECONDS = 10, 1800
LOCK_SECONDS = 900

# attack class -> entity the labelled sample is expected to name
EXPECTED_ATTACKS = {
    "volume_spike": "10.12.4.102",
    "data_exfil": "files.dropzone-sync.ru",
    "beaconing": "cdn-telemetry-sync.net",
    "blocked_threat": "malware-delivery.tk",
    "rare_destination": "paste-anon-share.onion.ly",
    "off_hours": "d.kim",
}
