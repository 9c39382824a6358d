"""Ranks, classes and labels derived from scores, kinds and codes."""

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from proxyspark import fixed


def enum_rank(value: Column, order: list[str]) -> Column:
    """1-based position in a meaningful order; 0 when unknown."""
    return F.array_position(F.array(*[F.lit(v) for v in order]), value).cast("int")


def severity_rank(c: Column) -> Column:
    return enum_rank(c, fixed.SEVERITIES)


def urgency_rank(c: Column) -> Column:
    return enum_rank(c, fixed.URGENCIES)


def level_rank(c: Column) -> Column:
    return enum_rank(c, fixed.ACCESS_LEVELS)


def level_name(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in fixed.ACCESS_LEVELS]), rank - 1)


def lookup(key: Column, table: dict, default) -> Column:
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def severity_for_score(score: Column) -> Column:
    out = F.lit("low")
    for floor, name in reversed(fixed.SEVERITY_FLOORS):
        out = F.when(score >= floor, name).otherwise(out)
    return out


def urgency_for_kind(kind: Column) -> Column:
    return lookup(kind, fixed.URGENCY_BY_KIND, fixed.DEFAULT_URGENCY)


def severity_for_kind(kind: Column) -> Column:
    return lookup(kind, fixed.SEVERITY_BY_KIND, fixed.DEFAULT_SEVERITY)


def action_required(urgency: Column) -> Column:
    return urgency.isin(fixed.ACTION_URGENCIES)


def action_label(recommendation: Column) -> Column:
    return F.nullif(F.left(recommendation, F.lit(fixed.ACTION_LABEL_CHARS)), F.lit(""))


def status_class(code: Column) -> Column:
    return (
        F.when(code >= 500, "server_error").when(code >= 400, "client_error")
        .when(code >= 300, "redirect").otherwise("success")
    )


def actor(username: Column, client_ip: Column) -> Column:
    return F.coalesce(F.nullif(username, F.lit("")), F.nullif(client_ip, F.lit("")), F.lit(fixed.UNKNOWN))


def is_parsed(ts: Column, client_ip: Column) -> Column:
    return ts.isNotNull() | client_ip.isNotNull()


def is_error(code: Column) -> Column:
    return code >= 400


def is_cache_hit(status: Column) -> Column:
    return F.contains(F.upper(status), F.lit("HIT"))


def score_from_z(z: Column, flag_at: float, certain_at: float) -> Column:
    """0 up to ``flag_at``, 1 from ``certain_at``, linear between."""
    ramp = (z - flag_at) / (certain_at - flag_at)
    return F.when(z <= flag_at, 0.0).otherwise(F.least(F.lit(1.0), ramp))


def finding_text(kind, explanation, recommendation, evidence: dict[str, Column]) -> Column:
    """Text embedded for one finding: prose plus the entities it names."""
    named = [
        F.concat(F.lit(f"{f}: "), F.nullif(evidence[f], F.lit("")))
        for f in fixed.FINDING_TEXT_FIELDS if f in evidence
    ]
    return F.concat_ws(
        "\n", F.replace(kind, F.lit("_"), F.lit(" ")), explanation,
        F.nullif(recommendation, F.lit("")), *named,
    )


def hash_identifier(value: Column, salt: str, prefix: str = "") -> Column:
    """Stable salted handle for a value that must not be stored itself."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), value.cast("string")), 256)
    return F.concat(F.lit(prefix), F.left(digest, F.lit(fixed.HASH_CHARS)))
