"""Upload to canonical rows to rollups, as one batch job."""

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proxyspark.operators.rollups import all_rollups, status_rollups
from proxyspark.operators.sketches import latency_sketches
from proxyspark.session import pin
from proxyspark.sources import logs, records, tables, versions


_OWNER = ["upload_id", "org_id", "user_id"]


def with_owner(files: DataFrame, org_id: str, user_id: str) -> DataFrame:
    """One upload per file, named by the file's path."""
    return files.withColumns({
        "upload_id": F.sha2("file", 256), "org_id": F.lit(org_id), "user_id": F.lit(user_id)})


def ingest_lines(spark: SparkSession, lines: DataFrame, root: str, org_id: str, user_id: str, now: datetime,
                 run: str, buckets: int = tables.BUCKETS) -> tuple[DataFrame, DataFrame, str]:
    """Parse scanned lines into the tables under ``root``.

    The raw text is read once, into the archive; everything after reads the
    archive, so line numbers and retries see the same lines. Rows and rollups
    are written before the manifest. Returns (upload ids, rejected files, version).

    All of it goes into one new version, which becomes visible in a single step:
    readers of ``versions.read_committed`` see an upload's old rows until then and
    its new ones after. New uploads never make a batch read the history.
    """
    pin(spark)
    archive, starts, listing, places = (
        f"{root}/{t}/run={run}" for t in ("archive", "archive_starts", "archive_files", "archive_splits"))
    tables.archive_raw(lines, archive, "overwrite")
    raw = spark.read.parquet(archive)
    text = raw.where(F.length("value") > 0)
    stamp = F.lit(str(now)).cast("timestamp")
    # One small row per file, written once: every later step starts from it.
    logs.header_places(text).write.mode("overwrite").parquet(starts)
    found = logs.detect_format(logs.file_headers(text, spark.read.parquet(starts)))
    with_owner(found, org_id, user_id).withColumn("created_at", stamp).write.mode("overwrite").parquet(listing)
    headers = spark.read.parquet(listing)
    records.with_numbers(records.places(raw, headers)).write.mode("overwrite").parquet(places)

    def interim(df: DataFrame, name: str) -> DataFrame:
        path = f"{root}/interim/run={run}/{name}"
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    lined = records.records(raw, headers, spark.read.parquet(places), interim)
    accepted = headers.where(F.col("format").isNotNull())
    ids = accepted.select("upload_id")
    entries = logs.normalize_logs(lined, headers, now)
    named = accepted.select(
        *_OWNER, F.element_at(F.split("file", "/"), -1).alias("filename"), "byte_size", "format", stamp.alias("created_at"),
        logs.object_key(F.col("org_id"), F.col("user_id"), stamp, F.col("upload_id")).alias("object_key"))
    version = store(spark, root, entries, named, versions.new_version(run), buckets)
    return ids, logs.rejected_files(headers), version


def store(spark: SparkSession, root: str, entries: DataFrame, files: DataFrame, version: str,
          buckets: int = tables.BUCKETS) -> str:
    """Entries of some uploads, their rollups and their manifest as one version.

    ``files`` is what ``logs.upload_manifest`` takes, a row per upload. Uploads that
    were there before are replaced in all tables at once.
    """
    versions.write_version(entries, root, "entries", version, buckets)
    stored = versions.read_version(spark, root, "entries", version)
    # Uploads without a single row still have a manifest row.
    stored = entries.where(F.lit(False)) if stored is None else stored
    versions.write_version(all_rollups(stored), root, "entry_rollups", version, buckets)
    versions.write_version(status_rollups(stored), root, "status_rollups", version, buckets)
    versions.write_version(latency_sketches(stored), root, "latency_sketches", version, buckets)
    manifest = logs.upload_manifest(stored, files)
    versions.write_version(manifest, root, "uploads", version, buckets)
    written = versions.read_version(spark, root, "uploads", version)
    if written is not None:
        versions.publish(spark, root, written.select(F.col("id").alias("upload_id")), version, buckets)
    return version


def ingest_files(spark: SparkSession, source, root: str, org_id: str, user_id: str, now: datetime,
                 run: str, buckets: int = tables.BUCKETS) -> DataFrame:
    """Ingest every log file below ``source``; returns the rejected files."""
    scanned = logs.scan_logs(spark, source, blank=True)
    return ingest_lines(spark, scanned, root, org_id, user_id, now, run, buckets)[1]


def reparse(spark: SparkSession, archive: str, now: datetime, owners: DataFrame | None = None, write=lambda df, name: df) -> DataFrame:
    """Entries again, from archived raw lines. ``write`` as in ``records.records``: large
    archives want one, as Spark then knows how few rows files and splits have."""
    return _parsed(spark.read.parquet(archive), now, owners, write)


def _parsed(raw: DataFrame, now: datetime, owners: DataFrame | None, write) -> DataFrame:
    headers = write(logs.detect_format(logs.file_headers(raw.where(F.length("value") > 0))), "headers")
    found = write(records.with_numbers(records.places(raw, headers)), "places")
    return logs.normalize_logs(records.records(raw, headers, found, write), headers, now, owners=owners)


def archived_lines(spark: SparkSession, root: str, key: str) -> DataFrame:
    """The raw lines stored for one upload, by the ``object_key`` of its manifest row.

    The manifest names the upload, the archive's listing the run and the file; only
    that run's folder is read, and only row groups that hold the file.
    """
    upload = versions.read_committed(spark, root, "uploads").where(F.col("object_key") == F.lit(key)).select(F.col("id").alias("upload_id"))
    listing = spark.read.parquet(f"{root}/archive_files").withColumn("run", F.col("run").cast("string"))
    # The newest run that brought the upload: one row.
    at = listing.join(upload, "upload_id", "left_semi").groupBy("upload_id", "org_id", "user_id").agg(
        F.max_by(F.struct("run", "file"), F.struct("created_at", "run")).alias("at")).first()
    if at is None:
        raise KeyError(f"no upload is stored as {key}")
    lines = spark.read.parquet(f"{root}/archive/run={at['at']['run']}")
    return lines.where(F.col("file") == F.lit(at["at"]["file"])).withColumns({
        c: F.lit(at[c]) for c in _OWNER})


def reparse_upload(spark: SparkSession, root: str, key: str, now: datetime, write=lambda df, name: df) -> DataFrame:
    """One upload's entries again, from what is archived under its ``object_key``;
    ``write`` as in ``reparse``."""
    raw = archived_lines(spark, root, key)
    owners = raw.select("file", *_OWNER).limit(1)
    return _parsed(raw.drop(*_OWNER), now, owners, write)
