"""Exact order statistics that never gather a whole group in one task.

Rows are first folded into *value counts* (one row per key and distinct value,
combined map-side), so duplicates cost nothing. Ranks are then found by running
sums over those counts.

* ``percentiles_of_counts``: for values with a bounded domain (milliseconds,
  counts per minute). One window per key over its distinct values.
* ``select_ranks``: for any numbers. A monotone log-scale bucket narrows each
  wanted rank to one bucket per key; only that bucket's values are ordered.

Fractions follow ``percentile_disc``: the first value whose cumulative share
reaches the fraction. Medians are the usual mean of the two middle values.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proxyspark import fixed

# Buckets per factor of e. Each bucket spans 0.025 % of its value, however
# small or large that is; the smallest double lies above bucket -_ORIGIN.
_BUCKETS_PER_E = 4096
_ORIGIN = 1 << 22
_MAX_LN = 710.0


def value_counts(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))


def percentiles_of_counts(counts: DataFrame, by: list[str], value: str,
                          fractions: dict[str, float], n: str = "n",
                          extra: list[Column] = ()) -> DataFrame:
    """One row per key with a discrete percentile per fraction.

    NULL values carry no weight, so ``counts`` may hold them for the sake of
    ``extra`` aggregates computed in the same pass.
    """
    keys = [F.col(k) for k in by] or [F.lit(0)]
    weight = F.when(F.col(value).isNotNull(), F.col(n)).otherwise(F.lit(0))
    ordered = Window.partitionBy(*keys).orderBy(F.col(value).asc_nulls_first())
    whole = Window.partitionBy(*keys)
    ranked = counts.withColumn("_w", weight).withColumn(
        "_upto", F.sum("_w").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn("_all", F.sum("_w").over(whole))
    reached = [
        F.min(F.when(
            F.col(value).isNotNull() & (F.col("_upto") >= F.ceil(F.col("_all") * F.lit(float(p)))),
            F.col(value),
        )).alias(name)
        for name, p in fractions.items()
    ]
    return ranked.groupBy(*by).agg(*reached, *extra)


def _bucket(value: Column) -> Column:
    """Monotone in the value, so whole buckets can be skipped by rank, and of
    one relative width at every scale. Infinite and NaN values share the last."""
    number = value.cast("double")
    size = F.floor(F.least(F.log(F.abs(number)), F.lit(_MAX_LN)) * _BUCKETS_PER_E) + F.lit(_ORIGIN)
    return F.when(number == 0, F.lit(0).cast("bigint")).when(number < 0, -size).otherwise(size)


def select_ranks(counts: DataFrame, by: list[str], value: str, ranks: dict[str, Column],
                 n: str = "n") -> DataFrame:
    """Values at the wanted 1-based ranks, one column per name.

    ``ranks`` maps a name to an expression over ``total`` (the key's weight).
    """
    # No value is without a bucket. Said here, or the join by it would filter one of two
    # readers and ``counts`` would be made twice.
    keyed = counts.where(F.col(value).isNotNull()).withColumn("_b", _bucket(F.col(value))).where(F.col("_b").isNotNull())
    keys = [F.col(k) for k in by] or [F.lit(0)]
    order = Window.partitionBy(*keys).orderBy("_b")
    whole = Window.partitionBy(*keys)
    histogram = (
        keyed.groupBy(*by, "_b").agg(F.sum(n).alias("_bn"))
        .withColumn("_upto", F.sum("_bn").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("total", F.sum("_bn").over(whole))
    )
    wanted = F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), F.greatest(expr.cast("bigint"), F.lit(1)).alias("rank"))
        for name, expr in ranks.items()
    ]))
    targets = (
        histogram.withColumn("_t", wanted)
        .where((F.col("_t.rank") <= F.col("_upto")) & (F.col("_t.rank") > F.col("_upto") - F.col("_bn")))
        .select(*by, "_b", F.col("_t.name").alias("_name"),
                (F.col("_t.rank") - F.col("_upto") + F.col("_bn")).alias("_rank"))
    )
    inside = keyed.join(targets, [*by, "_b"])
    cell = Window.partitionBy(*keys, "_name").orderBy(value)
    found = (
        inside.withColumn("_cum", F.sum(n).over(cell.rowsBetween(Window.unboundedPreceding, 0)))
        .where(F.col("_cum") >= F.col("_rank"))
    )
    picks = [
        F.min(F.when(F.col("_name") == name, F.col(value))).alias(name) for name in ranks
    ]
    return found.groupBy(*by).agg(*picks)


def counted_percentiles(counts: DataFrame, by: list[str], value: str, fractions: dict[str, float],
                        n: str = "n") -> DataFrame:
    """Discrete percentiles of value counts of any domain, also without a key."""
    ranks = {name: F.ceil(F.col("total") * F.lit(float(p))) for name, p in fractions.items()}
    return select_ranks(counts, by, value, ranks, n)


def percentiles(df: DataFrame, by: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """Discrete percentiles of an unbounded numeric column."""
    return counted_percentiles(value_counts(df, by, value), by, value, fractions)


def median_of_counts(counts: DataFrame, by: list[str], value: str, name: str, n: str = "n") -> DataFrame:
    low, high = F.floor((F.col("total") + 1) / 2), F.ceil((F.col("total") + 1) / 2)
    found = select_ranks(counts, by, value, {"_low": low, "_high": high}, n)
    middle = (F.col("_low").cast("double") + F.col("_high").cast("double")) / 2
    return found.select(*by, middle.alias(name))


def robust_baseline(counts: DataFrame, by: list[str], value: str, n: str = "n", bounded: bool = False) -> DataFrame:
    """Per key: ``observations``, ``median``, ``spread``.

    Spread is the scaled median absolute deviation; where that is 0 (most values
    equal) the population standard deviation stands in, as 0 would hide outliers.
    ``bounded`` says a key has few distinct values, so its medians may be taken
    by one aggregate instead of by rank selection.
    """
    weight, number = F.col(n), F.col(value).cast("double")
    size, mean = F.sum(weight).alias("observations"), (F.sum(number * weight) / F.sum(weight)).alias("_mean")
    if bounded:
        centre = counts.groupBy(*by).agg(size, mean, F.percentile(number, 0.5, weight).alias("median"))
    else:
        centre = counts.groupBy(*by).agg(size, mean).join(median_of_counts(counts, by, value, "median", n), by)
    apart = counts.join(centre, by).select(
        *by, "observations", "median", F.abs(number - F.col("median")).alias("_dev"), weight.alias("_dn"),
        (F.pow(number - F.col("_mean"), 2) * weight).alias("_sq"),
    )
    same = [F.first(c).alias(c) for c in ("observations", "median")]
    std = F.sqrt(F.sum("_sq") / F.sum("_dn")).alias("_std")
    if bounded:
        out = apart.groupBy(*by).agg(*same, std, F.percentile("_dev", 0.5, F.col("_dn")).alias("_mad"))
    else:
        mad = median_of_counts(apart, by, "_dev", "_mad", "_dn")
        out = apart.groupBy(*by).agg(*same, std).join(mad, by)
    scaled = F.col("_mad") * fixed.MAD_SCALE
    return out.select(
        *by, "observations", "median", F.when(scaled > 0, scaled).otherwise(F.col("_std")).alias("spread"),
    )


def robust_z(value: Column) -> Column:
    """Robust standard deviations above the median, given a joined baseline."""
    flat = F.when(value <= F.col("median"), 0.0).otherwise(fixed.IDENTICAL_SPREAD_Z)
    return F.when(F.col("spread") == 0, flat).otherwise(
        F.try_divide(value.cast("double") - F.col("median"), F.col("spread"))
    )
