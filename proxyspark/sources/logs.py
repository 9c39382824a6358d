"""Delimited proxy logs to canonical entries, keeping every line.

A file is split over many tasks, so nothing here assumes a task sees a whole
file: lines become records in ``records``, are numbered from per-split counts, and each file's header becomes
one small row of column positions joined to its lines.
"""

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proxyspark import fixed
from proxyspark.functions import labels, net, text
from proxyspark.sources.formats import LogFormat, formats

_FIELDS = list(fixed.FIELD_ALIASES)
_DELIMITERS = {",": ",", "\t": "\t", "|": r"\|"}


def scan_logs(spark: SparkSession, path, blank: bool = False) -> DataFrame:
    """Lines of every allowed file below ``path``, blank lines left out unless
    ``blank`` asks for them, as ``records.records`` does.

    ``split_start`` and ``pos`` give a line's place: the byte where its input
    split begins and a number that grows by one within a split. They are only
    meaningful within one read, so persist them (``archive_raw``) before
    numbering lines of large inputs.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    allowed = allowed_name(F.col("_metadata.file_path"))
    return lines.where(allowed if blank else allowed & (F.length("value") > 0)).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_block_start").alias("split_start"),
        F.monotonically_increasing_id().alias("pos"), "value",
    )


def allowed_name(filename: Column) -> Column:
    suffix = "|".join(s.lstrip(".") for s in fixed.LOG_SUFFIXES)
    return filename.rlike(rf"(?i)\.({suffix})$")


def detect_delimiter(line: Column) -> Column:
    """Comma unless tab, then pipe, occurs strictly more often."""
    count = lambda d: F.length(line) - F.length(F.replace(line, F.lit(d)))
    comma, tab, pipe = count(","), count("\t"), count("|")
    return (
        F.when(pipe > F.greatest(comma, tab), "|").when(tab > comma, "\t").otherwise(",")
    )


def _unquote(cell: Column) -> Column:
    inner = F.replace(F.substr(cell, F.lit(2)), F.lit('""'), F.lit('"'))
    quoted = cell.startswith('"') & cell.endswith('"') & (F.length(cell) >= 2)
    return F.when(quoted, F.left(inner, F.greatest(F.length(inner) - 1, F.lit(0)))).otherwise(cell)


def cells(line: Column, delimiter: Column) -> Column:
    """Cells of one record. Plain lines take the fast split; only lines with a
    quote go through the quote-aware pattern, which tolerates stray quotes."""
    def quoted(d):
        pattern = rf'{d}("[^"]*+(?:""[^"]*+)*+"[^{d}]*|[^{d}]*)'
        plain = "|" if d == r"\|" else d
        return F.transform(
            F.regexp_extract_all(F.concat(F.lit(plain), line), F.lit(pattern), F.lit(1)), _unquote)

    has_quote = F.contains(line, F.lit('"'))
    out = None
    for plain, pattern in _DELIMITERS.items():
        value = F.when(has_quote, quoted(pattern)).otherwise(F.split(line, pattern))
        out = F.when(delimiter == plain, value) if out is None else out.when(delimiter == plain, value)
    return out


def _positions(names: Column, log_format: LogFormat) -> Column:
    """Column position per canonical field: best alias first, then leftmost."""
    found = []
    for field in _FIELDS:
        spots = [F.nullif(F.array_position(names, a), F.lit(0)) for a in log_format.aliases.get(field, [])]
        found.append(((F.coalesce(*spots) - 1) if spots else F.lit(None)).cast("int").alias(field))
    return F.struct(*found)


def header_places(lines: DataFrame) -> DataFrame:
    """Where each file's first line is, and the file's size. Needs no line
    numbers: the smallest position in the split that starts the file."""
    return lines.where(F.col("split_start") == 0).groupBy("file").agg(
        F.min("pos").alias("pos"), F.max("file_size").alias("byte_size"))


def file_headers(lines: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """First line of each file, and its size where known.

    Only positions are aggregated; the text is picked by a join with them.
    ``places`` is ``header_places`` as a written table: its size is then known
    before the join is planned, and no line is shuffled while that is small.
    """
    if "line_no" in lines.columns:
        first = lines.where(F.col("line_no") == 1)
        return first.groupBy("file").agg(F.min("value").alias("header"))
    start = lines.where(F.col("split_start") == 0).select("file", "pos", F.col("value").alias("header"))
    picked = start.join(places if places is not None else header_places(lines), ["file", "pos"])
    return picked.select("file", "header", "byte_size")


def _is_one_of(names):
    return lambda cell: cell.isin(names)


def detect_format(headers: DataFrame, candidates: list[LogFormat] | None = None) -> DataFrame:
    """Adds ``delimiter``, ``format`` (NULL when unrecognised) and ``cols``."""
    known = candidates if candidates is not None else formats()
    delimited = headers.withColumn("delimiter", detect_delimiter(F.col("header")))
    raw_names = F.split("header", F.when(F.col("delimiter") == "|", r"\|").otherwise(F.col("delimiter")))
    named = delimited.withColumn("_sniff", F.transform(raw_names, text.normalize_name)).withColumn(
        "_names", F.transform(cells(F.col("header"), F.col("delimiter")), text.normalize_name))
    name, cols = F.lit(None).cast("string"), None
    for f in reversed(known):
        hits = F.size(F.filter("_sniff", _is_one_of(f.known_names)))
        fits = hits >= f.min_known
        name = F.when(fits, f.name).otherwise(name)
        cols = F.when(fits, _positions(F.col("_names"), f)) if cols is None else \
            F.when(fits, _positions(F.col("_names"), f)).otherwise(cols)
    return named.select(*headers.columns, "delimiter", name.alias("format"), cols.alias("cols"))


def rejected_files(headers: DataFrame) -> DataFrame:
    """Files whose header no format recognises."""
    return headers.where(F.col("format").isNull()).select("file", "header")


def split_offsets(lines: DataFrame) -> DataFrame:
    """Per input split, what turns a line's ``pos`` into its line number: a
    running sum of line counts over the file's splits."""
    place = ["file", "split_start"]
    counts = lines.groupBy(*place).agg(F.count(F.lit(1)).alias("_n"), F.min("pos").alias("_first"))
    earlier = Window.partitionBy("file").orderBy("split_start").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        *place, (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("shift"))


def number_lines(lines: DataFrame, offsets: DataFrame | None = None) -> DataFrame:
    """Adds ``line_no``; the header is 1.

    Only the offsets (one row per input split) are aggregated. No line is
    shuffled when ``offsets`` is a written table below Spark's own broadcast
    threshold in bytes; otherwise Spark picks the join.
    """
    side = offsets if offsets is not None else split_offsets(lines)
    return lines.join(side, ["file", "split_start"]).withColumn("line_no", F.col("pos") + F.col("shift")).drop("shift")


def normalize_logs(lines: DataFrame, headers: DataFrame, now: datetime,
                   owners: DataFrame | None = None) -> DataFrame:
    """Canonical entries of recognised files; a line that cannot be read keeps
    only ``raw``.

    ``lines`` has file, line_no, value; ``headers`` comes from
    ``detect_format``, best as a written table, whose size Spark knows.
    upload_id, org_id, user_id are columns of ``headers``, or ``owners`` maps
    file to them; with neither, the upload is named by its file.
    """
    owner = ["upload_id", "org_id", "user_id"]
    given = [c for c in owner if c in headers.columns and owners is None]
    side = headers.where(F.col("format").isNotNull()).select("file", "delimiter", "cols", *given)
    if owners is not None:
        side = side.join(owners, "file")
    elif given == owner:
        pass
    else:
        side = side.withColumns({
            "upload_id": F.sha2("file", 256), "org_id": F.lit(None).cast("string"),
            "user_id": F.lit(None).cast("string")})
    data = lines.where(F.col("line_no") > 1).join(side, "file")
    # Separate projections, so that no cell is cut or trimmed twice.
    split = data.withColumns({
        "_c": cells(F.col("value"), F.col("delimiter")), "_odd": text.has_odd_blanks(F.col("value"))})
    whole = ["upload_id", "org_id", "user_id", F.col("line_no").cast("int").alias("line_no")]
    bare = split.select(*whole, F.col("value").alias("raw"), *[
        text.strip_cell(F.get(F.col("_c"), F.col(f"cols.{f}")), F.col("_odd")).alias(f) for f in _FIELDS])
    named = bare.select(
        "upload_id", "org_id", "user_id", "line_no", "raw", *[text.drop_markers(F.col(f)).alias(f) for f in _FIELDS])
    ids = F.xxhash64("upload_id", "line_no").alias("id")
    return named.select(
        ids, "upload_id", "org_id", "user_id", "line_no",
        text.parse_ts(F.col("ts"), now).alias("ts"), net.parse_ip(F.col("client_ip")).alias("client_ip"),
        "username", F.coalesce("host", text.host_from_url(F.col("url"))).alias("host"), "url", "category",
        "action", text.parse_long(F.col("req_bytes")).alias("req_bytes"),
        text.parse_long(F.col("resp_bytes")).alias("resp_bytes"), "user_agent", "threat_name", "raw",
        text.parse_int(F.col("resp_code")).alias("resp_code"), F.upper("method").alias("method"),
        text.parse_int(F.col("latency_ms")).alias("latency_ms"), "cache_status", "reason",
    )


def upload_manifest(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest row per upload. ``files`` has upload_id, org_id, user_id,
    filename, byte_size, format, object_key, created_at; empty files are left
    out, and ``line_count`` includes the header."""
    sizes = entries.groupBy("upload_id").agg(
        (F.count(F.lit(1)) + 1).alias("line_count"),
        F.count_if(labels.is_parsed(F.col("ts"), F.col("client_ip"))).alias("parsed_count"),
    )
    return (
        files.where(F.col("byte_size") > 0).join(sizes, "upload_id", "left")
        .select(
            F.col("upload_id").alias("id"), "org_id", "user_id", "filename", "byte_size",
            F.coalesce("line_count", F.lit(1)).alias("line_count"),
            F.coalesce("parsed_count", F.lit(0)).alias("parsed_count"), "format", "object_key", "created_at",
        )
    )


def object_key(org_id: Column, user_id: Column, created_at: Column, upload_id: Column) -> Column:
    """Archive path: org/user/YYYY/MM/DD/id, in UTC."""
    return F.concat_ws("/", org_id, user_id, F.date_format(created_at, "yyyy/MM/dd"), upload_id)
