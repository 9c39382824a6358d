"""Who may see what: visibility, access levels, grants and audit lists.

Reads are per caller, as a screen asks them, or per request in bulk. Nothing
pairs every user with every upload of an organization.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proxyspark import fixed
from proxyspark.functions import labels
from proxyspark.operators.scope import Caller, clamp

_ADMINS = ["admin", "owner"]


def _live(grants: DataFrame, now) -> DataFrame:
    return grants.where(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(str(now)).cast("timestamp")))


def visible_uploads(caller: Caller, uploads: DataFrame, grants: DataFrame, now) -> DataFrame:
    """Uploads of the caller's organization they own, administer or were
    granted, for one upload or for the organization.

    The caller's grants are two equi-joins (by upload, by organization), not
    one join with an OR in it.
    """
    mine = uploads.where(F.col("org_id") == F.lit(caller.org_id))
    if caller.is_admin:
        return mine
    held = _live(grants, now).where(
        (F.col("subject_user_id") == F.lit(caller.id)) & (F.col("org_id") == F.lit(caller.org_id)))
    single = held.where(F.col("upload_id").isNotNull()).select(F.col("upload_id").alias("id")).distinct()
    whole = held.where(F.col("upload_id").isNull()).select("org_id").distinct()
    return (
        mine.join(single.withColumn("_one", F.lit(True)), "id", "left")
        .join(whole.withColumn("_all", F.lit(True)), "org_id", "left")
        .where((F.col("user_id") == F.lit(caller.id)) | F.col("_one").isNotNull() | F.col("_all").isNotNull())
        .select(*uploads.columns)
    )


def latest_analysis(analyses: DataFrame) -> DataFrame:
    """Most recent run per upload."""
    fields = [c for c in ("id", "status", "overall_risk") if c in analyses.columns]
    newest = F.max_by(F.struct(*fields), F.struct("created_at", "id")).alias("_a")
    return analyses.groupBy("upload_id").agg(newest).select(
        "upload_id", *[F.col(f"_a.{c}").alias(f"analysis_{c}" if c != "overall_risk" else c) for c in fields])


def list_visible_uploads(caller: Caller, uploads: DataFrame, grants: DataFrame, analyses: DataFrame, now) -> DataFrame:
    """The caller's uploads with their latest run, newest first."""
    seen = visible_uploads(caller, uploads, grants, now)
    # Only runs of visible uploads are reduced to their latest.
    runs = analyses.join(seen.select(F.col("id").alias("upload_id")), "upload_id", "left_semi")
    latest = latest_analysis(runs).withColumnRenamed("upload_id", "id")
    return seen.join(latest, "id", "left").orderBy(F.desc("created_at"), "id")


def resolve_levels(requests: DataFrame, users: DataFrame, uploads: DataFrame, grants: DataFrame, now) -> DataFrame:
    """Effective level of each requested (user_id, upload_id).

    Another organization's upload does not exist for the user; an owner has
    full access; otherwise the best live grant counts, and an administrator
    has at least the dashboard. ``level`` is NULL where there is no access.
    """
    asked = requests.select("user_id", "upload_id").distinct()
    people = users.select(F.col("id").alias("user_id"), F.col("org_id").alias("user_org"), "role")
    files = uploads.select(
        F.col("id").alias("upload_id"), F.col("org_id").alias("upload_org"), F.col("user_id").alias("owner_id"))
    rank = labels.level_rank(F.col("level"))
    live = _live(grants, now)
    # The best grant per key first, so a join never multiplies rows.
    single = (
        live.where(F.col("upload_id").isNotNull())
        .groupBy(F.col("subject_user_id").alias("user_id"), F.col("org_id").alias("upload_org"), "upload_id")
        .agg(F.max(rank).alias("_one"))
    )
    whole = (
        live.where(F.col("upload_id").isNull())
        .groupBy(F.col("subject_user_id").alias("user_id"), F.col("org_id").alias("upload_org"))
        .agg(F.max(rank).alias("_all"))
    )
    joined = (
        asked.join(people, "user_id").join(files, "upload_id")
        .join(single, ["user_id", "upload_org", "upload_id"], "left")
        .join(whole, ["user_id", "upload_org"], "left")
    )
    granted = F.greatest(F.coalesce("_one", F.lit(0)), F.coalesce("_all", F.lit(0)))
    dashboard = fixed.ACCESS_LEVELS.index("dashboard") + 1
    floor = F.when(F.col("role").isin(_ADMINS), F.greatest(granted, F.lit(dashboard))).otherwise(granted)
    level = (
        F.when(F.col("user_org") != F.col("upload_org"), 0)
        .when(F.col("owner_id") == F.col("user_id"), len(fixed.ACCESS_LEVELS)).otherwise(floor)
    )
    return joined.select(
        "user_id", "upload_id", "role", F.col("user_org").alias("org_id"), "owner_id", level.alias("level_rank"),
        labels.level_name(level).alias("level"),
    )


def require_level(levels: DataFrame, need: str) -> DataFrame:
    """Outcome of asking for a level: granted, breakglass, forbidden, not_found."""
    wanted = fixed.ACCESS_LEVELS.index(need) + 1
    outcome = (
        F.when(F.col("level_rank") == 0, "not_found").when(F.col("level_rank") >= wanted, "granted")
        .when(F.col("role").isin(_ADMINS), "breakglass").otherwise("forbidden")
    )
    effective = F.when(outcome == "breakglass", need).when(outcome == "granted", F.col("level"))
    return levels.withColumns({"outcome": outcome, "required_level": F.lit(need), "effective_level": effective})


def breakglass_audit(outcomes: DataFrame, now) -> DataFrame:
    """One audit row per escalation. Append it before serving the data."""
    detail = F.to_json(F.struct(
        F.col("level").alias("granted_level"), "required_level", "role",
        F.col("owner_id").cast("string").alias("upload_owner")))
    return outcomes.where(F.col("outcome") == "breakglass").select(
        "org_id", F.col("user_id").alias("actor_user_id"), F.lit("breakglass.raw_access").alias("action"),
        F.lit("upload").alias("resource_type"), F.col("upload_id").alias("resource_id"), detail.alias("detail"),
        F.lit(str(now)).cast("timestamp").alias("created_at"))


def best_grants(grants: DataFrame, now) -> DataFrame:
    """Best live grant per subject, organization and upload (NULL: org-wide)."""
    best = F.max(labels.level_rank(F.col("level")))
    return _live(grants, now).groupBy("subject_user_id", "org_id", "upload_id").agg(
        labels.level_name(best).alias("level"))


def mask_entry_ids(findings: DataFrame, levels: DataFrame, ids: str = "entry_ids") -> DataFrame:
    """Entry ids only for callers with full access to the upload."""
    full = levels.where(F.col("level_rank") >= len(fixed.ACCESS_LEVELS)).select("upload_id").distinct()
    marked = findings.join(full.withColumn("_full", F.lit(True)), "upload_id", "left")
    return marked.withColumn(ids, F.when(F.col("_full"), F.col(ids))).drop("_full")


def list_grants(caller: Caller, grants: DataFrame) -> DataFrame:
    """An administrator sees the organization's grants, a member those they
    issued or hold."""
    rows = grants.where(F.col("org_id") == F.lit(caller.org_id))
    if not caller.is_admin:
        rows = rows.where((F.col("granted_by") == F.lit(caller.id)) | (F.col("subject_user_id") == F.lit(caller.id)))
    return rows.orderBy(F.desc("created_at"), "id")


def list_members(caller: Caller, users: DataFrame) -> DataFrame:
    return users.where(F.col("org_id") == F.lit(caller.org_id)).orderBy("created_at", "id")


def list_audit(caller: Caller, audit: DataFrame, users: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest audit rows with the actor's address; administrators only."""
    if not caller.is_admin:
        raise PermissionError("only an administrator can read the audit log")
    newest = audit.where(F.col("org_id") == F.lit(caller.org_id)).orderBy(F.desc("created_at"), "id").limit(
        clamp(limit, fixed.AUDIT_LIMIT))
    people = users.select(F.col("id").alias("actor_user_id"), F.col("email").alias("actor_email"))
    return newest.join(people, "actor_user_id", "left").orderBy(F.desc("created_at"), "id")


def find_by_email(users: DataFrame, email: str) -> DataFrame:
    return users.where(F.lower("email") == F.lit(email.lower()))


def stale_analyses(analyses: DataFrame, uploads: DataFrame, now, seconds: int = fixed.STALE_SECONDS) -> DataFrame:
    """Running analyses whose heartbeat is too old, to be queued again."""
    limit = F.lit(str(now)).cast("timestamp") - F.make_dt_interval(secs=F.lit(seconds))
    silent = analyses.where((F.col("status") == "running") & (F.col("heartbeat_at") < limit))
    owners = uploads.select(F.col("id").alias("upload_id"), "user_id")
    return silent.join(owners, "upload_id").select(
        "id", "upload_id", "org_id", "user_id", "scope", "baseline_window_days",
        F.lit("queued").alias("status"), F.lit(None).cast("timestamp").alias("heartbeat_at"))


def redact(df: DataFrame, hash_cols: dict[str, str] | None = None, salt: str = "") -> DataFrame:
    """Drop fields that may carry log content; keep salted handles of some.

    ``hash_cols`` maps a column to the prefix of its handle ``<column>_hash``.
    """
    if hash_cols and not salt:
        raise ValueError("a salt is required to hash identifiers")
    handles = {f"{c}_hash": labels.hash_identifier(F.col(c), salt, p) for c, p in (hash_cols or {}).items()}
    return df.withColumns(handles).drop(*fixed.FORBIDDEN_FIELDS) if handles else df.drop(*fixed.FORBIDDEN_FIELDS)
