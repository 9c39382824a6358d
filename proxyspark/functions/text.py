"""Text, number and time expressions for log cells. All JVM-side."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from proxyspark import fixed

_SPACES = " \t\n\r\x0b\x0c\x85\xa0"
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def normalize_name(name: Column) -> Column:
    """Header cell in comparable form: lower-case letters and digits only."""
    return F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]", "")


def strip_cell(value: Column, odd_blanks: Column | None = None) -> Column:
    """Without surrounding blanks, then without surrounding quotes.

    ``odd_blanks`` tells, once per line, whether it has any blank other than a
    space; lines without one take the cheap trim.
    """
    full = F.trim(F.trim(value, F.lit(_SPACES)), F.lit('"'))
    if odd_blanks is None:
        return full
    bare = F.trim(value)
    quoted = bare.startswith('"') | bare.endswith('"')
    return F.when(odd_blanks | quoted, full).otherwise(bare)


def has_odd_blanks(line: Column) -> Column:
    return line.rlike(r"[\t\n\r\x0b\x0c\x85\xa0]")


def drop_markers(value: Column) -> Column:
    """Spellings of 'absent' become NULL."""
    return F.when(~value.isin(fixed.ABSENT_MARKERS), value)


def clean_value(value: Column) -> Column:
    return drop_markers(strip_cell(value))


def parse_ts(value: Column, now) -> Column:
    """Integer epoch (seconds, or milliseconds when large), else known layouts.

    The layout's shape is checked first, so each cell is parsed once: ISO-like
    text by the fast cast, the rest by its own pattern. ``now`` is the ingest
    time (a ``datetime``): a layout without a year takes its year from there,
    so a re-run gives the same answer. Fractions follow a point or a comma. A
    number of any length that is no instant gives NULL.
    """
    epoch = value.try_cast("bigint")
    seconds = F.when(epoch > fixed.EPOCH_MILLIS_ABOVE, F.floor(epoch / F.lit(1000))).otherwise(epoch)
    in_range = seconds.between(-fixed.EPOCH_SECONDS_WITHIN, fixed.EPOCH_SECONDS_WITHIN)
    pointed = F.translate(value, ",", ".")
    dated = F.concat(F.lit(f"{now.year} "), F.regexp_replace(pointed, r"\s+", " "))
    return (
        F.when(value.rlike(fixed.TIMESTAMP_SHAPES["iso"]), pointed.try_cast("timestamp"))
        .when(value.rlike(fixed.TIMESTAMP_SHAPES["epoch"]), F.when(in_range, F.timestamp_seconds(seconds)))
        .when(value.rlike(fixed.TIMESTAMP_SHAPES["slashes"]), F.translate(value, "/,", "-.").try_cast("timestamp"))
        .when(value.rlike(fixed.TIMESTAMP_SHAPES["access_log"]), F.try_to_timestamp(pointed, F.lit(fixed.ACCESS_LOG_PATTERN)))
        .when(value.rlike(fixed.TIMESTAMP_SHAPES["yearless"]), F.try_to_timestamp(dated, F.lit(fixed.YEARLESS_PATTERN)))
    )


def parse_long(value: Column) -> Column:
    """Decimal text truncated to a whole number; negatives are 0, bad text NULL."""
    number = F.when(value.rlike(_NUMBER), value.try_cast("double"))
    return F.when(number < 0, F.lit(0).cast("bigint")).otherwise(number.try_cast("bigint"))


def parse_int(value: Column) -> Column:
    return parse_long(value).try_cast("int")


def host_from_url(url: Column) -> Column:
    """Between '://' and the next '/' or ':'. NULL when nothing is left."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(url)
    host = F.substring_index(F.substring_index(rest, "/", 1), ":", 1)
    return F.nullif(host, F.lit(""))


def iso8601(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx")


def split_words(text: Column) -> Column:
    """Lower-case alphanumeric runs, in order."""
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")
