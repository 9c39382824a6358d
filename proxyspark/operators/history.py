"""Baselines of many runs measured against history, in one pass for all of them.

A run's window is "the organization's hours since ..., without its own upload". Pairing
runs with hours would multiply them, so sums over time are running sums per organization
or upload, in which a run looks up its place: what the organization has since, less what
the run's own upload put there. Hours are whole, so a window starts at one, runs that ask
the same of one upload are one question, and a running sum meets each start only once.
The median is found digit by digit: counts per leading digit give each question the digit
that holds its middle row, and only rows below that digit count in the next step.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a digit; a run looks at 2**DIGIT counts per digit.
DIGIT = 6
#: A question: what has happened since, beside the own upload.
_ASKED = ["org_id", "upload_id", "since"]


def _since(counts: DataFrame, asked: DataFrame, by: list[str], sums: list[str]) -> DataFrame:
    """Per distinct (by, since) of ``asked`` the sums of ``counts`` (by, hour, sums) of the
    same ``by`` from hour ``since`` on: both lie on one line per key, newest first."""
    line = counts.select(*by, "hour", *sums, F.lit(0).alias("_asks")).unionByName(
        asked.select(*by, F.col("since").alias("hour")).distinct().withColumn("_asks", F.lit(1)), allowMissingColumns=True)
    newer = Window.partitionBy(*by).orderBy(F.desc("hour"), "_asks").rowsBetween(Window.unboundedPreceding, 0)
    return line.withColumns({c: F.coalesce(F.sum(c).over(newer), F.lit(0)) for c in sums}).where("_asks = 1").select(
        *by, F.col("hour").alias("since"), *sums)


def _less_own(asked: DataFrame, counts: DataFrame, by: list[str], sums: list[str]) -> DataFrame:
    """``asked`` (org_id, upload_id, since and whatever else is in ``by``) with the sums of
    its organization's hours since, less those of its own upload."""
    own_by, org_by = ["org_id", "upload_id", *by], ["org_id", *by]
    per = lambda keys: counts.groupBy(*keys, "hour").agg(*[F.sum(c).alias(c) for c in sums])
    whole, own = _since(per(org_by), asked, org_by, sums), _since(per(own_by), asked, own_by, sums)
    # An unknown start takes every hour, and an unknown organization is one of its own;
    # no upload is one's own by being unknown.
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"w.{c}")) for c in [*org_by, "since"]]
    seen = asked.alias("a").join(whole.alias("w"), same).select("a.*", *[F.col(f"w.{c}").alias(c) for c in sums])
    mine = own.select(*own_by, "since", *[F.col(c).alias(f"{c}_own") for c in sums])
    return seen.join(mine, [*own_by, "since"], "left").select(
        *asked.columns, *[(F.col(c) - F.coalesce(f"{c}_own", F.lit(0))).alias(c) for c in sums])


def _hosts(hours: DataFrame, asked: DataFrame) -> DataFrame:
    """Distinct hosts: those seen since, less those that only the own upload saw since."""
    last = hours.groupBy("org_id", "host", "upload_id").agg(F.max("hour").alias("hour"))
    # The upload that saw a host last, and the last that any other did.
    order = Window.partitionBy("org_id", "host").orderBy(F.desc("hour"), "upload_id")
    ends = last.withColumns({"_n": F.row_number().over(order), "next": F.lead("hour").over(order)}).where("_n = 1")
    # Hosts of the own upload alone: its hour is in the window, the other's, which is no
    # later, is not. So what counts for the organization counts less while only it saw it.
    counted = ends.select("org_id", "upload_id", F.explode(F.array(
        F.struct("hour", F.lit(1).alias("hosts"), F.lit(1).alias("only")),
        F.struct(F.col("next").alias("hour"), F.lit(0).alias("hosts"), F.lit(-1).alias("only")))).alias("e")).select(
        "org_id", "upload_id", "e.*").where("hour IS NOT NULL")
    seen = _since(counted.groupBy("org_id", "hour").agg(F.sum("hosts").alias("hosts")), asked, ["org_id"], ["hosts"])
    only = _since(counted.groupBy("org_id", "upload_id", "hour").agg(F.sum("only").alias("only")), asked, ["org_id", "upload_id"], ["only"])
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"w.{c}")) for c in ("org_id", "since")]
    return asked.alias("a").join(seen.alias("w"), same).select("a.*", "w.hosts").join(
        only, _ASKED, "left").select(*_ASKED, (F.col("hosts") - F.coalesce("only", F.lit(0))).alias("hosts"))


def _digit(value: Column, level: int) -> Column:
    return F.shiftright(value, DIGIT * level)


def _medians(hours: DataFrame, sizes: DataFrame, write) -> DataFrame:
    """The discrete median of hourly requests of every question with a row in its window."""
    top = hours.agg(F.max("requests")).first()[0] or 0
    values = hours.groupBy("org_id", "upload_id", "hour", "requests").agg(F.sum("rows").alias("n"))
    state = sizes.where("rows > 0").select(*_ASKED, F.ceil(F.col("rows") / 2).alias("left"), F.lit(0).cast("bigint").alias("prefix"))
    for level in range(max(1, -(-top.bit_length() // DIGIT)) - 1, -1, -1):
        counts = values.groupBy("org_id", "upload_id", "hour", _digit(F.col("requests"), level).alias("digit")).agg(F.sum("n").alias("n"))
        asked = state.withColumn("digit", F.explode(F.sequence(
            F.shiftleft("prefix", DIGIT), F.shiftleft("prefix", DIGIT) + F.lit((1 << DIGIT) - 1))))
        held = _less_own(asked, counts, ["digit"], ["n"]).where("n > 0")
        upto = Window.partitionBy(*_ASKED).orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
        state = write(held.withColumn("_upto", F.sum("n").over(upto)).where(
            (F.col("_upto") >= F.col("left")) & (F.col("_upto") - F.col("n") < F.col("left"))).select(
            *_ASKED, (F.col("left") - (F.col("_upto") - F.col("n"))).alias("left"), F.col("digit").alias("prefix")),
            f"median_{level}")
    return state.select(*_ASKED, F.col("prefix").cast("double").alias("median_hourly_requests"))


def history_baselines(rollups: DataFrame, runs: DataFrame, write=lambda df, name: df) -> DataFrame:
    """Context for every run measured against history: window_days, requests, errors,
    distinct hosts and the discrete median of hourly rows of its organization, from
    ``window_days`` before it was created on, without the run's own upload.

    ``rollups`` are hour rollups of all organizations; ``runs`` has id, org_id,
    upload_id, created_at, baseline_window_days (NULL: measured against its file, left
    out). Log rows are never read. ``write(df, name)`` keeps the state between digits.
    """
    hours = rollups.where(F.col("grain") == "hour").select(
        "org_id", "upload_id", "host", F.col("bucket_start").alias("hour"), "requests", "errors", F.lit(1).alias("rows"))
    since = F.col("created_at") - F.make_dt_interval(F.col("baseline_window_days"))
    # The first whole hour at or after it.
    start = F.date_trunc("hour", since + F.expr("INTERVAL '3599.999999' SECOND"))
    asked = runs.where(F.col("baseline_window_days").isNotNull()).select(
        F.col("id").alias("run_id"), "org_id", "upload_id", start.alias("since"), F.col("baseline_window_days").alias("window_days"))
    keys = write(asked.select(*_ASKED).distinct(), "questions")
    sums = write(_less_own(keys, hours, [], ["requests", "errors", "rows"]), "sums")
    parts = [_hosts(hours, keys), _medians(hours, sums, write)]
    both = lambda a, b, how: a.alias("a").join(b.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in _ASKED], how).select(
        "a.*", *[F.col(f"b.{c}") for c in b.columns if c not in _ASKED])
    answers = write(reduce(lambda a, b: both(a, b, "left"), parts, sums.drop("rows")), "answers")
    return both(asked, answers, "left").select(
        "run_id", "window_days", "requests", "errors", "hosts", F.coalesce("median_hourly_requests", F.lit(0.0)).alias("median_hourly_requests"))
