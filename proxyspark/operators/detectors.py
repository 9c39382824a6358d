"""Six statistical threat detectors.

Each runs over all scopes at once: ``by`` (the upload, by default) leads every
key, and a scope's baseline is an aggregate joined back to it. Scores compare a
scope with itself. No detector collects entry ids or gathers a busy key's rows:
scoring uses sums, extremes and value counts, and ``finding_entries`` links the
few surviving candidates back to rows.

Output of each: ``by``, ``kind``, ``title``, ``score``, ``entry_count``, entity
columns (client_ip, username, host, threat_name, actor) and a typed
``evidence`` struct.
"""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proxyspark import fixed
from proxyspark.functions import labels
from proxyspark.functions.text import iso8601
from proxyspark.operators.order_stats import robust_baseline, robust_z

BY = ("upload_id",)
_ENTITIES = ["client_ip", "username", "host", "threat_name", "actor"]


def _title(kind: str, *parts: str):
    return F.format_string(fixed.TITLES[kind], *[F.col(p) for p in parts])


def _iso(column: str):
    return iso8601(F.col(column))


def _named(column: str):
    return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(fixed.UNKNOWN))


def _capped(scored: DataFrame, by, per_detector: int | None) -> DataFrame:
    """Best ``per_detector`` per scope, or all where that is None. The rank
    filter becomes a per-task limit before the shuffle, so a scope with very
    many candidates does not fill one task."""
    enough = scored.where(F.col("score") >= fixed.MIN_SCORE)
    if per_detector is None:
        return enough
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "title")
    return enough.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per_detector).drop("_r")


def _shape(df: DataFrame, by, kind: str, entities: dict[str, str], evidence) -> DataFrame:
    columns = [
        (F.col(entities[e]) if e in entities else F.lit(None).cast("string")).alias(e) for e in _ENTITIES
    ]
    return df.select(
        *by, F.lit(kind).alias("kind"), "title", F.col("score").cast("double").alias("score"),
        F.col("entry_count").cast("bigint").alias("entry_count"), *columns, F.struct(*evidence).alias("evidence"),
    )


# --- volume_spike ------------------------------------------------------------------

def _minute_counts(entries: DataFrame, by) -> DataFrame:
    return (
        entries.where(F.col("client_ip").isNotNull() & F.col("ts").isNotNull())
        .groupBy(*by, "client_ip", F.date_trunc("minute", "ts").alias("minute"))
        .agg(F.count(F.lit(1)).alias("hits"))
    )


def spike_minutes(entries: DataFrame, by=BY) -> DataFrame:
    """(client_ip, minute) buckets scoring above zero against all buckets."""
    by = list(by)
    minutes = _minute_counts(entries, by)
    baseline = robust_baseline(minutes.groupBy(*by, "hits").agg(F.count(F.lit(1)).alias("n")), by, "hits", bounded=True)
    enough = baseline.where(F.col("observations") >= fixed.MIN_SPIKE_BUCKETS)
    z = robust_z(F.col("hits"))
    return (
        minutes.where(F.col("hits") >= fixed.MIN_BURST_REQUESTS).join(enough, by)
        .withColumn("score", labels.score_from_z(z, fixed.SPIKE_FLAG_Z, fixed.SPIKE_CERTAIN_Z))
        .where(F.col("score") > 0)
    )


def volume_spike(entries: DataFrame, by=BY, per_detector: int | None = fixed.MAX_PER_DETECTOR) -> DataFrame:
    """Unusually many requests from one address within a minute."""
    by = list(by)
    grouped = spike_minutes(entries, by).groupBy(*by, "client_ip").agg(
        F.max("score").alias("score"), F.max("hits").alias("peak"), F.first("median").alias("median"),
        F.count(F.lit(1)).alias("minutes"), F.min("minute").alias("first"), F.max("minute").alias("last"),
        F.sum("hits").alias("entry_count"),
    ).withColumn("title", _title("volume_spike", "client_ip"))
    return _shape(_capped(grouped, by, per_detector), by, "volume_spike", {"client_ip": "client_ip"}, [
        "client_ip", F.col("peak").alias("peak_requests_per_minute"),
        F.bround("median", 1).alias("median_requests_per_minute"),
        F.col("minutes").alias("minutes_affected"), _iso("first").alias("window_start"),
        _iso("last").alias("window_end"), F.col("entry_count").alias("total_requests"),
    ])


# --- data_exfil --------------------------------------------------------------------

def data_exfil(entries: DataFrame, by=BY, per_detector: int | None = fixed.MAX_PER_DETECTOR) -> DataFrame:
    """Outbound transfers far above the scope's norm, on a log10 scale."""
    by = list(by)
    sent = entries.where(F.col("req_bytes") > 0)
    sizes = sent.groupBy(*by, "req_bytes").agg(F.count(F.lit(1)).alias("n"))
    logs = sizes.select(*by, F.log10("req_bytes").alias("log_bytes"), "n")
    baseline = robust_baseline(logs, by, "log_bytes").where(F.col("observations") >= fixed.MIN_EXFIL_ROWS)
    pairs = sent.groupBy(*by, _named("username").alias("username"), _named("host").alias("host")).agg(
        F.max("req_bytes").alias("largest"), F.sum("req_bytes").alias("total"),
        F.count(F.lit(1)).alias("entry_count"),
    )
    z = robust_z(F.log10("largest"))
    scored = (
        pairs.join(baseline, by)
        .withColumn("score", labels.score_from_z(z, fixed.EXFIL_FLAG_Z, fixed.EXFIL_CERTAIN_Z))
        .withColumn("title", _title("data_exfil", "username", "host"))
    )
    return _shape(_capped(scored, by, per_detector), by, "data_exfil", {"username": "username", "host": "host"}, [
        "username", "host", F.col("total").alias("total_bytes_sent"),
        F.col("entry_count").alias("request_count"), F.col("largest").alias("largest_request_bytes"),
        F.floor(F.pow(F.lit(10.0), "median")).alias("median_request_bytes"),
    ])


# --- beaconing ---------------------------------------------------------------------

def beaconing(entries: DataFrame, by=BY, min_hits: int = fixed.MIN_BEACON_HITS,
              per_detector: int | None = fixed.MAX_PER_DETECTOR) -> DataFrame:
    """Near-constant intervals between requests of one address to one host.

    Equal timestamps add no interval, so a pair is first folded to distinct
    instants. The mean interval then follows from first, last and their number,
    which rejects floods before any ordering: what is left has at least five
    seconds between instants, however many rows the pair had.
    """
    by = list(by)
    pair = [*by, "client_ip", "host"]
    instants = (
        entries.where(F.col("client_ip").isNotNull() & F.col("host").isNotNull() & F.col("ts").isNotNull())
        .groupBy(*pair, "ts").agg(F.count(F.lit(1)).alias("n"))
    )
    seconds = F.unix_micros("ts") / F.lit(1e6)
    low, high = fixed.BEACON_MEAN_SECONDS
    # Both branches read the same columns, so the folded instants are shuffled
    # once and reused.
    series = (
        instants.groupBy(*pair).agg(
            F.sum("n").alias("_hits"), F.count(F.lit(1)).alias("_k"),
            F.min("ts").alias("first"), F.max("ts").alias("last"),
        )
        .where((F.col("_hits") >= min_hits) & (F.col("_k") >= min_hits) & (F.col("_k") >= 2))
        .withColumn("mean_gap", (F.unix_micros("last") - F.unix_micros("first")) / F.lit(1e6) / (F.col("_k") - 1))
        .where(F.col("mean_gap").between(low, high))
    )
    order = Window.partitionBy(*pair).orderBy("ts")
    gaps = (
        instants.join(series.select(*pair), pair, "left_semi")
        .withColumn("gap", seconds - F.lag(seconds).over(order))
        .groupBy(*pair).agg(F.stddev_pop("gap").alias("gap_stdev"), F.sum("n").alias("entry_count"))
    )
    scored = (
        series.join(gaps, pair)
        .withColumn("regularity", 1 - F.col("gap_stdev") / F.col("mean_gap"))
        .where(F.col("regularity") >= fixed.BEACON_MIN_REGULARITY)
        .withColumn("score", F.least(F.lit(1.0), (F.col("regularity") - fixed.BEACON_MIN_REGULARITY)
                                     / fixed.BEACON_REGULARITY_SPAN))
        .withColumn("title", _title("beaconing", "client_ip", "host"))
    )
    return _shape(_capped(scored, by, per_detector), by, "beaconing", {"client_ip": "client_ip", "host": "host"}, [
        "client_ip", "host", F.col("entry_count").alias("request_count"),
        F.bround("mean_gap", 1).alias("mean_interval_seconds"),
        F.bround("gap_stdev", 2).alias("interval_stdev_seconds"),
        F.bround("regularity", 4).alias("regularity"),
        _iso("first").alias("first_seen"), _iso("last").alias("last_seen"),
    ])


# --- blocked_threat ----------------------------------------------------------------

def _distinct_list(rows: DataFrame, keys: list[str], value: str, name: str, first: int | None = None) -> DataFrame:
    """Sorted distinct values per key, optionally only the first few.

    Values are made distinct before the key's list is built."""
    distinct = rows.where(F.col(value).isNotNull()).select(*keys, value).distinct()
    if first is not None:
        order = Window.partitionBy(*keys).orderBy(value)
        distinct = distinct.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= first)
    return distinct.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias(name))


def _or_empty(column: str):
    return F.coalesce(F.col(column), F.array().cast("array<string>")).alias(column)


def blocked_threat(entries: DataFrame, by=BY, per_detector: int | None = fixed.MAX_PER_DETECTOR) -> DataFrame:
    """Malware and phishing the proxy itself identified; fixed confidence."""
    by = list(by)
    keys = [*by, "threat_name", "host"]
    hits = entries.where(F.col("threat_name").isNotNull()).select(
        *by, "threat_name", _named("host").alias("host"), "username", "action",
    )
    scored = (
        hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("entry_count"))
        .withColumn("score", F.lit(fixed.THREAT_SCORE)).withColumn("title", _title("blocked_threat", "threat_name", "host"))
    )
    top = _capped(scored, by, per_detector)
    cited = hits.join(top.select(*keys), keys, "left_semi")
    full = (
        top.join(_distinct_list(cited, keys, "username", "users"), keys, "left")
        .join(_distinct_list(cited, keys, "action", "actions"), keys, "left")
    )
    return _shape(full, by, "blocked_threat", {"threat_name": "threat_name", "host": "host"}, [
        "threat_name", "host", F.col("entry_count").alias("hit_count"), _or_empty("users"), _or_empty("actions"),
    ])


# --- rare_destination --------------------------------------------------------------

def rare_destination(entries: DataFrame, by=BY, per_detector: int | None = fixed.MAX_PER_DETECTOR) -> DataFrame:
    """Hosts reached by exactly one user, at most three times.

    Counts per (host, user) come first: plain counters that combine map-side.
    A kept host has a single user: its counts are read once more as they are, with
    their sum, so that Spark makes them once. Addresses are looked up for kept hosts only.
    """
    by = list(by)
    keys = [*by, "host"]
    seen = entries.where(F.col("host").isNotNull())
    users = seen.groupBy(*keys, "username").agg(F.count(F.lit(1)).alias("n"))
    hosts = users.groupBy(*keys).agg(F.sum("n").alias("entry_count"), F.count("username").alias("_users"))
    busiest = hosts.groupBy(*by).agg(F.max("entry_count").alias("busiest"), F.count(F.lit(1)).alias("_hosts"))
    rare = hosts.where((F.col("entry_count") <= fixed.RARE_MAX_HITS) & (F.col("_users") == 1))
    raw = F.log10(F.col("busiest") / F.col("entry_count") + 1) / F.log10(F.col("busiest") + 1)
    scored = (
        rare.join(busiest.where(F.col("_hosts") >= fixed.MIN_RARE_HOSTS), by)
        .withColumn("score", F.bround(F.least(F.lit(1.0), raw), 3))
        .withColumn("title", _title("rare_destination", "host"))
    )
    top = _capped(scored, by, per_detector)
    rest = [c for c in top.columns if c != "entry_count"]
    named = top.select(*rest).join(users, keys).groupBy(*rest).agg(
        F.max("username").alias("username"), F.sum("n").alias("entry_count"))
    cited = seen.select(*keys, "url").join(top.select(*keys), keys, "left_semi")
    full = named.join(
        _distinct_list(cited, keys, "url", "urls", fixed.RARE_EVIDENCE_URLS), keys, "left")
    return _shape(full, by, "rare_destination", {"host": "host", "username": "username"}, [
        "host", F.col("entry_count").alias("hit_count"), F.lit(1).alias("distinct_users"), "username",
        F.col("busiest").alias("busiest_host_hits"), _or_empty("urls"),
    ])


# --- off_hours ---------------------------------------------------------------------

def _actor_hours(entries: DataFrame, by) -> DataFrame:
    """Entries per hour of the day and actor. That the hour is there is said here: a join
    by it would add this filter on one side only, and Spark would make the counts twice."""
    return entries.where(F.col("ts").isNotNull() & F.hour("ts").isNotNull()).groupBy(
        *by, F.hour("ts").alias("hour"), labels.actor(F.col("username"), F.col("client_ip")).alias("actor"),
    ).agg(F.count(F.lit(1)).alias("hits"))


def _quiet_hours(actor_hours: DataFrame, by) -> DataFrame:
    """Hours of the day far below the scope's median hour (24 rows at most)."""
    hours = actor_hours.groupBy(*by, "hour").agg(F.sum("hits").alias("volume"))
    middle = hours.groupBy(*by).agg(F.median("volume").alias("median"), F.count(F.lit(1)).alias("_hours"))
    return hours.join(middle, by).where(
        (F.col("_hours") >= fixed.MIN_HOURS_SEEN) & (F.col("volume") < fixed.QUIET_HOUR_RATIO * F.col("median"))
    ).select(*by, "hour", "volume", "median")


def off_hours(entries: DataFrame, by=BY, per_detector: int | None = fixed.MAX_PER_DETECTOR) -> DataFrame:
    """Sustained activity in hours that are quiet for this data."""
    by = list(by)
    actor_hours = _actor_hours(entries, by)
    quiet = _quiet_hours(actor_hours, by)
    grouped = actor_hours.join(quiet, [*by, "hour"]).groupBy(*by, "actor").agg(
        F.sum("hits").alias("entry_count"), F.avg("volume").alias("volume"), F.first("median").alias("median"),
        F.array_sort(F.collect_list("hour")).alias("hours"),
    ).where(F.col("entry_count") >= fixed.MIN_OFF_HOURS_REQUESTS)
    quietness = 1 - F.col("volume") / F.col("median")
    activity = F.least(F.lit(1.0), F.col("entry_count") / fixed.OFF_HOURS_FULL_REQUESTS)
    scored = (
        grouped.withColumn("score", F.bround(F.least(F.lit(1.0), quietness * activity), 3))
        .withColumn("title", _title("off_hours", "actor"))
    )
    top = _capped(scored, by, per_detector)
    keys = [*by, "actor"]
    rows = entries.where(F.col("ts").isNotNull()).select(
        *by, F.hour("ts").alias("hour"), labels.actor(F.col("username"), F.col("client_ip")).alias("actor"), "host",
    )
    cited = rows.join(top.select(*keys, F.explode("hours").alias("hour")), [*keys, "hour"], "left_semi")
    full = top.join(_distinct_list(cited, keys, "host", "hosts", fixed.OFF_HOURS_EVIDENCE_HOSTS), keys, "left")
    return _shape(full, by, "off_hours", {"actor": "actor"}, [
        "actor", F.col("entry_count").alias("request_count"), "hours",
        F.col("median").alias("median_hourly_volume"), F.bround("volume", 1).alias("these_hours_volume"),
        _or_empty("hosts"),
    ])


DETECTORS = {
    "volume_spike": volume_spike,
    "data_exfil": data_exfil,
    "beaconing": beaconing,
    "blocked_threat": blocked_threat,
    "rare_destination": rare_destination,
    "off_hours": off_hours,
}


def detect_all(entries: DataFrame, by=BY, per_detector: int | None = fixed.MAX_PER_DETECTOR) -> DataFrame:
    """All detectors in one table, ranked per scope, evidence as JSON.

    ``candidate_id`` is the opaque handle c0, c1, ... in global order.
    ``per_detector`` is how many candidates of a detector a scope keeps, as a
    packet wants them; None keeps every candidate that scores.
    """
    by = list(by)
    found = [
        detector(entries, by, per_detector=per_detector).withColumn("evidence", F.to_json("evidence")) for detector in DETECTORS.values()
    ]
    union = reduce(DataFrame.unionByName, found)
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "kind", "title")
    ranked = union.withColumn("rank", F.row_number().over(order))
    return ranked.withColumn("candidate_id", F.concat(F.lit("c"), (F.col("rank") - 1).cast("string")))


def finding_entries(candidates: DataFrame, entries: DataFrame, by=BY) -> DataFrame:
    """Bridge table candidate -> log entry: every row a candidate cites.

    One equi-join per kind. Candidates are few; the entry side is pruned to its
    keys and never gathered.
    """
    by = list(by)
    ref = [*by, "kind", "candidate_id"]

    def cited(kind, rows, keys, also=None):
        """Rows of the kind's candidates; ``also`` narrows them afterwards, so
        it only meets rows of an actor already under suspicion."""
        wanted = candidates.where(F.col("kind") == kind).select(*ref, *[k for k in keys if k not in by])
        found = rows.join(wanted, keys)
        if also is not None:
            found = found.join(also, also.columns, "left_semi")
        return found.select(*ref, F.col("id").alias("entry_id"))

    who = labels.actor(F.col("username"), F.col("client_ip")).alias("actor")
    with_ip = entries.where(F.col("client_ip").isNotNull() & F.col("ts").isNotNull())
    parts = [
        cited("volume_spike", with_ip.select(*by, "client_ip", F.date_trunc("minute", "ts").alias("minute"), "id"),
              [*by, "client_ip"], spike_minutes(entries, by).select(*by, "client_ip", "minute")),
        cited("data_exfil", entries.where(F.col("req_bytes") > 0).select(
            *by, _named("username").alias("username"), _named("host").alias("host"), "id"), [*by, "username", "host"]),
        cited("beaconing", with_ip.where(F.col("host").isNotNull()).select(*by, "client_ip", "host", "id"),
              [*by, "client_ip", "host"]),
        cited("blocked_threat", entries.where(F.col("threat_name").isNotNull()).select(
            *by, "threat_name", _named("host").alias("host"), "id"), [*by, "threat_name", "host"]),
        cited("rare_destination", entries.where(F.col("host").isNotNull()).select(*by, "host", "id"), [*by, "host"]),
        cited("off_hours", entries.where(F.col("ts").isNotNull()).select(*by, F.hour("ts").alias("hour"), who, "id"),
              [*by, "actor"], _quiet_hours(_actor_hours(entries, by), by).select(*by, "hour")),
    ]
    return reduce(DataFrame.unionByName, parts)
