"""Whose data a dashboard covers, and over which time window."""

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proxyspark import fixed


@dataclass(frozen=True)
class Caller:
    id: object
    org_id: str
    role: str = "member"

    @property
    def is_admin(self) -> bool:
        return self.role in ("admin", "owner")


@dataclass(frozen=True)
class Scope:
    """Half-open window over one organization, optionally one user."""

    org_id: str
    start: datetime
    end: datetime
    user_id: object = None


def scope_for(caller: Caller, now: datetime, start=None, end=None, org_wide: bool = False) -> Scope:
    """Defaults: the caller's own data, the last 30 days up to a minute ahead.

    A member asking for the organization is refused, not silently narrowed.
    """
    start, end = _instant(start, "from"), _instant(end, "to")
    start = start or now - timedelta(days=fixed.DEFAULT_WINDOW_DAYS)
    end = end or now + timedelta(minutes=1)
    if end < start:
        raise ValueError("to is before from")
    if org_wide and not caller.is_admin:
        raise PermissionError("only an administrator can view organization-wide figures")
    return Scope(caller.org_id, start, end, None if org_wide else caller.id)


def _instant(value, name):
    if not isinstance(value, str):
        return value
    try:
        found = datetime.fromisoformat(value)
    except ValueError as err:
        raise ValueError(f"{name} must be an RFC3339 timestamp") from err
    if found.tzinfo is None:
        raise ValueError(f"{name} must be an RFC3339 timestamp")
    return (found - found.utcoffset()).replace(tzinfo=None)


def _owned(df: DataFrame, scope: Scope) -> DataFrame:
    mine = F.col("org_id") == F.lit(scope.org_id)
    if scope.user_id is not None:
        mine = mine & (F.col("user_id") == F.lit(scope.user_id))
    return df.where(mine)


def _stamp(moment: datetime):
    return F.lit(moment.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")


def apply_scope(df: DataFrame, scope: Scope, ts_col: str = "ts") -> DataFrame:
    """Tenancy and time filter; also prunes on ``month`` where tables have it."""
    ts = F.col(ts_col)
    out = _owned(df, scope).where((ts >= _stamp(scope.start)) & (ts < _stamp(scope.end)))
    if "month" in df.columns:
        out = out.where(F.col("month").between(scope.start.strftime("%Y-%m"), scope.end.strftime("%Y-%m")))
    return out


def apply_tenancy(df: DataFrame, scope: Scope) -> DataFrame:
    """The tenancy filter alone, for questions about what data exists at all."""
    return _owned(df, scope)


def clamp(limit, bounds: tuple[int, int]) -> int:
    """A limit outside 1..max falls back to the default."""
    default, most = bounds
    return limit if limit is not None and 0 < limit <= most else default


def analysis_scope(scope: str, window_days: int | None):
    """('file', None) unless history was asked for; history needs 1..365 days."""
    if scope != "history":
        return "file", None
    days = window_days if window_days and window_days > 0 else fixed.BASELINE_DEFAULT_DAYS
    if days > fixed.BASELINE_MAX_DAYS:
        raise ValueError(f"baseline_window_days cannot exceed {fixed.BASELINE_MAX_DAYS}")
    return "history", days


def scope_violations(analyses: DataFrame) -> DataFrame:
    """Runs whose window does not match their scope (should be none)."""
    file_ok = (F.col("scope") == "file") & F.col("baseline_window_days").isNull()
    history_ok = (F.col("scope") == "history") & F.col("baseline_window_days").isNotNull()
    return analyses.where(~(file_ok | history_ok))
