"""Canonical table schemas."""

from pyspark.sql import types as T

_s, _l, _i, _d, _t, _b = (
    T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(),
    T.TimestampType(), T.BooleanType(),
)


def _struct(*fields):
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


LOG_ENTRY = _struct(
    ("id", _l), ("upload_id", _s), ("org_id", _s), ("user_id", _s), ("line_no", _i),
    ("ts", _t), ("client_ip", _s), ("username", _s), ("host", _s), ("url", _s),
    ("category", _s), ("action", _s), ("req_bytes", _l), ("resp_bytes", _l),
    ("user_agent", _s), ("threat_name", _s), ("raw", _s), ("resp_code", _i),
    ("method", _s), ("latency_ms", _i), ("cache_status", _s), ("reason", _s),
)
ENTRY_ROLLUP = _struct(
    ("org_id", _s), ("user_id", _s), ("upload_id", _s), ("host", _s), ("grain", _s),
    ("bucket_start", _t), ("requests", _l), ("bytes_in", _l), ("bytes_out", _l),
    ("errors", _l), ("cache_hits", _l), ("cache_total", _l), ("latency_p50", _i),
    ("latency_p95", _i), ("latency_p99", _i), ("latency_count", _l),
)
STATUS_ROLLUP = _struct(
    ("org_id", _s), ("user_id", _s), ("upload_id", _s), ("bucket_start", _t),
    ("resp_code", _i), ("reason", _s), ("requests", _l), ("latency_p95", _i),
)
UPLOAD = _struct(
    ("id", _s), ("org_id", _s), ("user_id", _s), ("filename", _s), ("byte_size", _l),
    ("line_count", _l), ("parsed_count", _l), ("format", _s), ("object_key", _s),
    ("created_at", _t),
)
ANALYSIS = _struct(
    ("id", _s), ("org_id", _s), ("upload_id", _s), ("status", _s), ("scope", _s),
    ("baseline_window_days", _i), ("overall_risk", _s), ("summary", _s),
    ("timeline", _s), ("model", _s), ("input_tokens", _i), ("output_tokens", _i),
    ("error", _s), ("created_at", _t), ("started_at", _t), ("finished_at", _t),
    ("heartbeat_at", _t),
)
FINDING = _struct(
    ("id", _s), ("analysis_id", _s), ("kind", _s), ("severity", _s), ("urgency", _s),
    ("action_required", _b), ("action_label", _s), ("confidence", _d),
    ("explanation", _s), ("recommendation", _s), ("entry_count", _l),
)
CANDIDATE = _struct(
    ("upload_id", _s), ("kind", _s), ("title", _s), ("score", _d), ("entry_count", _l),
    ("evidence", _s), ("rank", _i), ("candidate_id", _s),
)
TIMING = _struct(
    ("analysis_id", _s), ("org_id", _s), ("user_id", _s), ("stage", _s),
    ("duration_ms", _d), ("created_at", _t),
)
USER = _struct(
    ("id", _s), ("org_id", _s), ("email", _s), ("role", _s), ("created_at", _t),
)
GRANT = _struct(
    ("id", _s), ("org_id", _s), ("upload_id", _s), ("subject_user_id", _s),
    ("level", _s), ("granted_by", _s), ("expires_at", _t), ("created_at", _t),
)
AUDIT = _struct(
    ("id", _s), ("org_id", _s), ("actor_user_id", _s), ("action", _s),
    ("resource_type", _s), ("resource_id", _s), ("detail", _s), ("created_at", _t),
)
