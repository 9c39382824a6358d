"""Records from lines: a quoted cell may hold line breaks, wherever a file is split.

Whether a line starts a record depends on every quote before it. One line alone,
though, is a function of one bit: where it leaves the reader (inside a quoted cell or
not), for either state it may start in. There are four such functions: leave as it
was, swap, always outside, always inside. They compose: the state before a line is the
last constant's value, swapped as often as a swapping line came since. So a running
maximum and a running count give it inside a split, and the same over one row per
split gives the state each split starts in.

Almost no file needs this. Lines without a quote change nothing, and only where some
line of a file could open a cell that it does not close, or where blank lines lie
between others, are the lines of that file (or that split) looked at in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SPLIT = ["file", "split_start"]


def ends_inside(line: Column, delimiter: Column, inside: Column) -> Column:
    """1 where the reader is inside a quoted cell after ``line``, else 0.

    ``inside`` says where it starts. A quote opens a cell at its very start; inside,
    two quotes are a quote, one before a delimiter or at the end closes the cell, any
    other is text. Outside, a quote later in a cell is text.
    """
    pieces = F.split(line, '"', -1)

    def step(state: Column, i: Column, parts: Column) -> Column:
        before, after = F.get(parts, i - 1), F.get(parts, i)
        last = i == F.size(parts) - 1
        closes = ((after == "") & last) | F.startswith(after, delimiter)
        opens = ((i == 1) & (before == "")) | F.endswith(before, delimiter)
        return (
            F.when(state == 2, 1)  # the second of two quotes
            .when(state == 1, F.when((after == "") & ~last, 2).when(closes, 0).otherwise(1))
            .otherwise(F.when(opens, 1).otherwise(0)))

    walked = F.get(F.transform(F.array(pieces), lambda parts: F.aggregate(
        F.sequence(F.lit(1), F.size(parts) - 1), inside.cast("int"), lambda state, i: step(state, i, parts))), 0)
    return F.when(F.contains(line, F.lit('"')), walked).otherwise(inside.cast("int"))


def places(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """Per input split: how many lines are not blank, the first and last of them, and
    how many could open a cell that they do not close.

    ``lines``: file, split_start, pos, value, blank lines included; ``headers``: file
    and delimiter, best as a written table. Plain counters; no text is shuffled.
    """
    opens = ends_inside(F.col("value"), F.col("delimiter"), F.lit(0))
    return lines.join(headers.select("file", "delimiter"), "file").where(F.length("value") > 0).groupBy(*_SPLIT).agg(
        F.count(F.lit(1)).alias("_n"), F.min("pos").alias("_first"), F.max("pos").alias("_last"), F.sum(opens).alias("_openers"))


def with_numbers(found: DataFrame) -> DataFrame:
    """``places`` with what turns a plain split's ``pos`` into a line number, and
    ``_in_order``: whether its lines must be looked at in order."""
    by_file = Window.partitionBy("file")
    earlier = by_file.orderBy("split_start").rowsBetween(Window.unboundedPreceding, -1)
    return found.select(
        *_SPLIT, "_n", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("shift"),
        (F.sum("_openers").over(by_file) > 0).alias("_quoted"),
        (F.col("_last") - F.col("_first") + 1 > F.col("_n")).alias("_gaps"))


def _composed(keys: list[str], order: str, before: bool) -> tuple[Column, Column]:
    """Value of the last constant function (NULL without one), swapped by the swaps
    since, and the parity of all swaps, up to a row or before it."""
    window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    swaps = F.coalesce(F.sum((F.col("_from0") > F.col("_from1")).cast("int")).over(window), F.lit(0)) % 2
    return F.last("_mark", ignorenulls=True).over(window), swaps


def _ordered(lines: DataFrame) -> DataFrame:
    """Adds ``_inside``, the state a line starts in, ``_ends``, the one it leaves, and
    ``_record``, the number of records of its file up to it. ``lines`` are those of
    files or splits to look at in order, with delimiter, shift and flags."""
    quoted = F.col("_quoted")
    state = lambda s: F.when(quoted, ends_inside(F.col("value"), F.col("delimiter"), F.lit(s))).otherwise(F.lit(s))
    acted = lines.withColumns({"_from0": state(0), "_from1": state(1)})
    # A constant's value is kept free of the swaps before it; they are put back below.
    own = Window.partitionBy(*_SPLIT).orderBy("pos")
    swaps = F.sum((F.col("_from0") > F.col("_from1")).cast("int")).over(own) % 2
    marked = acted.withColumn("_mark", F.when(F.col("_from0") == F.col("_from1"), F.col("_from0").bitwiseXOR(swaps.cast("int"))))
    value, parity = _composed(_SPLIT, "pos", True)
    local = marked.withColumns({"_value": value, "_parity": parity.cast("int")})
    ends_value, ends_parity = F.coalesce(F.col("_mark"), F.col("_value")), (
        F.col("_parity") + (F.col("_from0") > F.col("_from1")).cast("int")) % 2
    # One row per split: what the whole split makes of either state.
    whole = local.groupBy(*_SPLIT).agg(F.max_by(F.struct(ends_value.alias("v"), ends_parity.alias("p")), "pos").alias("_e"))
    apply = lambda v, p, s: F.coalesce(v, s).bitwiseXOR(p.cast("int"))
    summed = whole.select(*_SPLIT, *[apply(F.col("_e.v"), F.col("_e.p"), F.lit(s)).alias(f"_from{s}") for s in (0, 1)])
    by_file = Window.partitionBy("file").orderBy("split_start")
    swaps_of_splits = F.sum((F.col("_from0") > F.col("_from1")).cast("int")).over(by_file) % 2
    summed = summed.withColumn("_mark", F.when(F.col("_from0") == F.col("_from1"), F.col("_from0").bitwiseXOR(swaps_of_splits.cast("int"))))
    value, parity = _composed(["file"], "split_start", True)
    starts = summed.select(*_SPLIT, apply(value, parity, F.lit(0)).alias("_start"))
    inside = apply(F.col("_value"), F.col("_parity"), F.col("_start"))
    return local.join(starts, _SPLIT).withColumn("_inside", inside).withColumn(
        "_ends", F.when(F.col("_inside") == 1, F.col("_from1")).otherwise(F.col("_from0"))).drop(
        "_from0", "_from1", "_mark", "_value", "_parity", "_start")


def records(lines: DataFrame, headers: DataFrame, found: DataFrame, write=lambda df, name: df) -> DataFrame:
    """Records (file, value, line_no) of ``lines``; the header is 1.

    ``found`` is ``with_numbers``, best as a written table; ``write(df, name)`` writes an
    interim table and reads it back (by default it is planned anew). A record that goes on over lines keeps its line
    breaks, blank lines included; other blank lines are skipped and not counted. A quote
    that no later line of its file closes opens nothing: from there on each line is a
    record. Lines of splits without such quotes and gaps are numbered by addition and
    never shuffled.
    """
    side = found.drop("_n")
    all_lines = lines.join(side, _SPLIT)
    plain = ~F.col("_quoted") & ~F.col("_gaps")
    simple = all_lines.where(plain & (F.length("value") > 0)).select("file", "value", (F.col("pos") + F.col("shift")).alias("line_no"))
    odd = found.where(~plain)
    if odd.isEmpty():
        return simple
    rows = all_lines.where(~plain).join(headers.select("file", "delimiter"), "file").select(
        *_SPLIT, "pos", "value", "delimiter", "_quoted")
    ordered = write(_ordered(rows), "ordered")
    # A cell that is open where its file ends: its first line, and all behind it, stand alone.
    begins = (F.col("_inside") == 0) & (F.col("_ends") == 1)
    # Per split first, then one row per file: written, so that Spark sees how small it is
    # and the lines stay dealt by split, not by file.
    ends = ordered.where("_quoted").groupBy(*_SPLIT).agg(F.max_by("_ends", "pos").alias("_last"), F.max(F.when(begins, F.col("pos"))).alias("pos"))
    tail = ends.groupBy("file").agg(
        F.max_by("_last", "split_start").alias("_open"), F.max(F.when(F.col("pos").isNotNull(), F.struct("split_start", "pos"))).alias("_from"))
    tail = write(tail.where("_open = 1").select("file", "_from"), "tail")
    at = F.struct("split_start", "pos")
    settled = ordered.join(tail, "file", "left").withColumn("_alone", F.coalesce(at >= F.col("_from"), F.lit(False))).withColumns({
        "_inside": F.when(F.col("_alone"), 0).otherwise(F.col("_inside")), "_ends": F.when(F.col("_alone"), 0).otherwise(F.col("_ends"))})
    starts = ((F.col("_inside") == 0) & (F.length("value") > 0)).cast("int")
    counted = settled.withColumn("_upto", F.sum(starts).over(Window.partitionBy(*_SPLIT).orderBy("pos")))
    # Records of whole splits, those that need no order among them.
    looked = counted.groupBy(*_SPLIT).agg(F.max("_upto").alias("_records"))
    per_split = found.join(looked, _SPLIT, "left").select(*_SPLIT, F.coalesce("_records", "_n").alias("_records"))
    earlier = Window.partitionBy("file").orderBy("split_start").rowsBetween(Window.unboundedPreceding, -1)
    bases = write(per_split.select(*_SPLIT, F.coalesce(F.sum("_records").over(earlier), F.lit(0)).alias("_base")), "bases")
    numbered = counted.join(bases, _SPLIT).withColumn("line_no", F.col("_base") + F.col("_upto"))
    single = numbered.where("_inside = 0 AND _ends = 0 AND length(value) > 0").select("file", "value", "line_no")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("split_start", "pos", "value"))), lambda x: x["value"])
    joined = numbered.where("_inside = 1 OR _ends = 1").groupBy("file", "line_no").agg(F.array_join(parts, "\n").alias("value"))
    return simple.unionByName(single).unionByName(joined.select("file", "value", "line_no"))
