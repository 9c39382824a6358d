"""Sign-in throttling over a stored table, exact across both dimensions.

An attempt that one dimension turns away is counted by neither, so address and account
hang on one another. Nobody needs one order over all attempts for that: each verdict
depends on earlier attempts only, so there is exactly one set of verdicts that agrees
with itself. It is reached by judging addresses with the accounts' last verdicts, then
accounts with the addresses' new ones, until a round changes nothing. Each round settles
at least the next link of every chain of verdicts that hang on one another.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proxyspark import fixed
from proxyspark.session import pin

_JUDGED = "id long, at long, ip string, account string, success boolean, ip_span long, account_span long, "
_FLAGS = "by_ip boolean, by_account boolean, before boolean, ip_failures long, account_failures long"
_SECOND = 1_000_000


def busy_spans(attempts: DataFrame, key: str, seconds: int, name: str) -> DataFrame:
    """Adds ``name``, the start of the busy span an attempt of ``key`` lies in: a key
    that was silent for ``seconds`` has nothing left to count, so spans are judged apart.

    A busy key is first folded to its cells of ``seconds``, in which no gap can be that
    long; only cells are put in order.
    """
    width = seconds * _SECOND
    celled = attempts.withColumn("_cell", F.floor(F.col("at") / width))
    cells = celled.where(F.col(key).isNotNull()).groupBy(key, "_cell").agg(F.min("at").alias("_first"), F.max("at").alias("_last"))
    order = Window.partitionBy(key).orderBy("_cell")
    gap = F.col("_first") - F.lag("_last").over(order)
    starts = cells.withColumn("_start", F.when(gap.isNull() | (gap >= width), F.col("_first")))
    spans = starts.select(key, "_cell", F.last("_start", True).over(order).alias(name))
    return celled.join(spans, [key, "_cell"], "left").drop("_cell")


def _scan(key: str, by_account: bool, limit: int, window: int, lock: int):
    """Judges spans in order; what is remembered is one span's counter."""
    own, other = ("by_account", "by_ip") if by_account else ("by_ip", "by_account")
    tally = f"{key}_failures"

    def run(frames):
        at_span, anchor, failures, locked = None, 0, 0, 0
        for frame in frames:
            verdicts, counts = [], []
            for name, span, at, success, elsewhere in zip(
                    frame[key], frame[f"{key}_span"], frame["at"], frame["success"], frame[other]):
                if name is None:
                    verdicts.append(False)
                    counts.append(0)
                    continue
                if (name, span) != at_span:
                    at_span, anchor, failures, locked = (name, span), 0, 0, 0
                if failures and at >= anchor + window:
                    failures = 0
                blocked = at < locked if by_account else failures >= limit
                if blocked or elsewhere:
                    pass  # turned away: neither counted nor believed
                elif not success:
                    anchor = at if failures == 0 else anchor
                    failures += 1
                    if by_account and failures >= limit:
                        locked = at + lock
                elif by_account:
                    failures = locked = 0
                verdicts.append(blocked)
                counts.append(failures)
            yield frame.assign(**{own: verdicts, tally: counts})

    return run


def _judge(rows: DataFrame, key: str, limit: int, window: int, lock: int = 0) -> DataFrame:
    span = f"{key}_span"
    # Rows without a key are judged by nobody, so they need not meet in one task.
    spread = F.when(F.col(key).isNull(), F.xxhash64("id", "at")).otherwise(F.col(span))
    dealt = rows.repartition(F.col(key), spread).sortWithinPartitions(key, span, "at", "id", "success", "ip", "account")
    return dealt.mapInPandas(
        _scan(key, key == "account", limit, window * _SECOND, lock * _SECOND), _JUDGED + _FLAGS)


def throttle_attempts(auth: DataFrame, root: str,
                      ip_rule: tuple[int, int] = (fixed.IP_FAILURES, fixed.IP_WINDOW_SECONDS),
                      account_rule: tuple[int, int] = (fixed.ACCOUNT_FAILURES, fixed.ACCOUNT_WINDOW_SECONDS),
                      lock_seconds: int = fixed.LOCK_SECONDS) -> DataFrame:
    """``id, ts, ip, account, decision, ip_failures, account_failures`` per sign-in
    attempt (id, ts, ip, account, success), as if judged one after the other by (ts, id).

    ``decision`` is ``throttled`` (address), ``locked`` (account) or ``allowed``; the
    counters are those right after the attempt. Rules are (failures, seconds) from the
    first failure on. An attempt without address or account is not counted there, one
    without a time is left out, an unknown outcome is a failure. Accounts are compared
    trimmed and without case. ``root`` is a new shared folder: each round is a table
    there, so a lost executor costs a part of one round.
    """
    spark = pin(auth.sparkSession)
    rows = auth.where(F.col("ts").isNotNull()).select(
        F.col("id").cast("long").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "ip",
        F.lower(F.trim("account")).alias("account"), F.coalesce("success", F.lit(False)).alias("success"))
    rows = busy_spans(rows, "ip", ip_rule[1], "ip_span")
    rows = busy_spans(rows, "account", max(account_rule[1], lock_seconds), "account_span")
    no, zero = F.lit(False), F.lit(0).cast("long")
    rows = rows.select("id", "at", "ip", "account", "success", "ip_span", "account_span", no.alias("by_ip"),
                       no.alias("by_account"), no.alias("before"), zero.alias("ip_failures"), zero.alias("account_failures"))
    for turn in count():
        by_ip = _judge(rows.withColumn("before", F.col("by_account")), "ip", *ip_rule)
        _judge(by_ip, "account", *account_rule, lock_seconds).write.parquet(f"{root}/round={turn}")
        rows = spark.read.parquet(f"{root}/round={turn}")
        if rows.where(F.col("before") != F.col("by_account")).isEmpty():
            break
    decision = F.when(F.col("by_ip"), "throttled").when(F.col("by_account"), "locked").otherwise("allowed")
    return rows.select("id", F.timestamp_micros("at").alias("ts"), "ip", "account", decision.alias("decision"),
                       "ip_failures", "account_failures")
