"""Table writes: append, replace, erase. Plain Parquet, no table format.

Entries are partitioned by event month and by a hash bucket of the upload, so
the number of folders depends on time and a constant, not on the number of
uploads. A rebalance before writing splits a bucket that one busy upload fills
and joins small ones, which keeps files even.

Replacing rows rewrites only touched partitions (dynamic overwrite). A touched
partition left without rows is removed explicitly, as dynamic overwrite never
does that.
"""

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proxyspark.functions import net

BUCKETS = 64
NO_MONTH = "none"


def _bucket(column: str, buckets: int):
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


def _month(column: str):
    return F.coalesce(F.date_format(column, "yyyy-MM"), F.lit(NO_MONTH))


def with_layout(df: DataFrame, kind: str, buckets: int = BUCKETS) -> DataFrame:
    """Adds the partition columns of a table kind."""
    if kind == "entries":
        keyed = df.withColumn("ip_key", net.ip_key(F.col("client_ip"))) if "client_ip" in df.columns else df
        return keyed.withColumns({"month": _month("ts"), "bucket": _bucket("upload_id", buckets)})
    if kind in ("entry_rollups", "status_rollups", "latency_sketches", "analyses", "grants", "bridge"):
        return df.withColumns({"bucket": _bucket("upload_id", buckets)})
    if kind in ("findings", "vectors", "timings", "status"):
        return df.withColumns({"bucket": _bucket("analysis_id", buckets)})
    if kind == "uploads":
        return df.withColumns({"bucket": _bucket("id", buckets)})
    if kind == "audit":
        return df.withColumns({"month": _month("created_at")})
    raise ValueError(f"unknown table kind {kind!r}")


LAYOUT = {
    "entries": (["month", "bucket"], ["org_id", "ts"]),
    "entry_rollups": (["grain", "bucket"], ["org_id", "bucket_start"]),
    "status_rollups": (["bucket"], ["org_id", "bucket_start"]),
    "latency_sketches": (["bucket"], ["org_id", "bucket_start"]),
    "uploads": (["bucket"], ["org_id", "created_at"]),
    "findings": (["bucket"], ["analysis_id"]),
    "vectors": (["bucket"], ["analysis_id"]),
    "analyses": (["bucket"], ["upload_id"]),
    "grants": (["bucket"], ["upload_id"]),
    "bridge": (["bucket"], ["upload_id"]),
    "timings": (["bucket"], ["analysis_id"]),
    "status": (["bucket"], ["analysis_id"]),
    "archive": (["run"], ["split_start", "pos"]),
    "archive_files": (["run"], ["file"]),
    "archive_starts": (["run"], ["file"]),
    "archive_splits": (["run"], ["file", "split_start"]),
    "audit": (["month"], ["org_id", "created_at"]),
}


def _write(df: DataFrame, path: str, kind: str, mode: str, dynamic: bool = False) -> None:
    parts, order = LAYOUT[kind]
    out = df.hint("rebalance", *[F.col(p) for p in parts]).sortWithinPartitions(*parts, *order).write.mode(mode)
    if dynamic:
        out = out.option("partitionOverwriteMode", "dynamic")
    out.partitionBy(*parts).parquet(path)


def write_entries(entries: DataFrame, path: str, buckets: int = BUCKETS, mode: str = "append") -> None:
    """Append canonical entries; rows without a time go to month 'none'."""
    _write(with_layout(entries, "entries", buckets), path, "entries", mode)


def write_table(df: DataFrame, path: str, kind: str, buckets: int = BUCKETS, mode: str = "append") -> None:
    _write(with_layout(df, kind, buckets), path, kind, mode)


def archive_raw(lines: DataFrame, path: str, mode: str = "append") -> None:
    """Raw lines, compressed, so history can be parsed again. Keeps each line's
    place, which makes later line numbers reproducible. Needs no shuffle."""
    parts = [c for c in ("org_id", "user_id", "date", "upload_id") if c in lines.columns]
    out = lines.write.mode(mode).option("compression", "zstd")
    (out.partitionBy(*parts) if parts else out).parquet(path)


def write_index(index: DataFrame, path: str) -> None:
    """Store a search index by token range, so a token filter skips files."""
    index.repartitionByRange("token", "finding_id").sortWithinPartitions("token", "finding_id").write.mode(
        "overwrite").parquet(path)


def append_audit(df: DataFrame, path: str) -> None:
    _write(with_layout(df, "audit"), path, "audit", "append")


def append_timings(df: DataFrame, path: str) -> None:
    _write(with_layout(df, "timings"), path, "timings", "append")


def append_status(df: DataFrame, path: str) -> None:
    _write(with_layout(df, "status"), path, "status", "append")


def read_if_present(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored table, or None where nothing was written or nothing is left."""
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm):
        return None
    try:
        return spark.read.parquet(path)
    except AnalysisException as err:
        if err.getCondition() == "UNABLE_TO_INFER_SCHEMA":
            return None
        raise


def _drop_partitions(spark: SparkSession, path: str, parts: list[str], gone: set[tuple]) -> None:
    for values in gone:
        folder = "/".join(f"{c}={v}" for c, v in zip(parts, values))
        jvm = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{folder}")
        jvm.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm, True)


def _in_partitions(df: DataFrame, parts: list[str], wanted: set[tuple]) -> DataFrame:
    """Literal partition filter, so only those folders are listed and read."""
    if not wanted:
        return df.where(F.lit(False))
    tests = [
        reduce(lambda a, b: a & b, [F.col(c) == F.lit(v) for c, v in zip(parts, values)])
        for values in sorted(wanted, key=str)
    ]
    return df.where(reduce(lambda a, b: a | b, tests))


def _read_text_partitions(spark: SparkSession, path: str, parts: list[str]) -> DataFrame | None:
    """The stored table with its partition values as written: a run named 007
    must not be read, and written back, as 7."""
    found = read_if_present(spark, path)
    if found is None:
        return None
    fields = [T.StructField(f.name, T.StringType()) if f.name in parts and f.name != "bucket" else f for f in found.schema]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def delete_keys(spark: SparkSession, path: str, kind: str, keys: DataFrame, buckets: int | None = None,
                runs: list[str] | None = None) -> int:
    """Remove the rows whose key column is in ``keys``; how many there were.

    Only partitions that hold such rows are rewritten. ``buckets``, the number
    the table is written with, or ``runs`` lets the search for them skip other
    folders; without either every partition's key column is read.
    """
    wanted = keys.distinct()
    near = None
    if buckets is not None:
        near = [r[0] for r in wanted.select(_bucket(keys.columns[0], buckets).alias("b")).distinct().collect()]
        if not near:
            return 0
    parts, key = LAYOUT[kind][0], keys.columns[0]
    stored = _read_text_partitions(spark, path, parts)
    if stored is None:
        return 0
    if near is not None:
        stored = stored.where(F.col("bucket").isin(near))
    if runs is not None:
        stored = stored.where(F.col("run").isin(runs))
    tally = (
        stored.select(*parts, key).join(wanted.withColumn("_gone", F.lit(1)), key, "left")
        .groupBy(*parts).agg(F.count("_gone").alias("gone"), F.count(F.lit(1)).alias("rows"))
        .where(F.col("gone") > 0).collect()
    )
    touched = {tuple(r)[:-2]: r["rows"] - r["gone"] for r in tally}
    if touched:
        kept = _in_partitions(stored, parts, set(touched)).join(wanted, key, "left_anti")
        _write(kept, path, kind, "overwrite", dynamic=True)
        _drop_partitions(spark, path, parts, {values for values, left in touched.items() if not left})
    return sum(r["gone"] for r in tally)


def replace_rows(df: DataFrame, path: str, kind: str, key: str, keys: DataFrame | None = None,
                 buckets: int = BUCKETS) -> None:
    """Replace all stored rows of the keys in ``df``; other keys are kept.

    Old rows go first, then the new ones are appended, so partitions that only
    receive rows are not rewritten. Running it again changes nothing. ``keys``
    names the keys that may have old rows, where that is cheaper than deriving
    them from ``df``. Between the two writes a key shows no rows: tables that must
    never do so are written as versions (``versions.publish``).
    """
    delete_keys(df.sparkSession, path, kind, (keys if keys is not None else df).select(key), buckets)
    _write(with_layout(df, kind, buckets), path, kind, "append")


def save_findings(findings: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Replace the findings of each analysis present in ``findings``."""
    replace_rows(findings, path, "findings", "analysis_id", buckets=buckets)


def save_vectors(vectors: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    replace_rows(vectors, path, "vectors", "analysis_id", buckets=buckets)


def committed(df: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows of uploads the manifest lists. It is written last, so a job that
    died midway shows nothing, and its repeat replaces what it left."""
    return df.join(manifest.select(F.col("id").alias("upload_id")), "upload_id", "left_semi")


def erase_uploads(spark: SparkSession, root: str, ids: DataFrame, org_id: str, buckets: int | None = None) -> DataFrame:
    """Remove uploads of one organization everywhere; counts per table.

    ``ids`` has upload_id. Ids of other organizations erase nothing. With the
    uploads go their entries, rollups, cited rows and grants, their runs with
    findings, vectors, timings and status (a run is named in ``analyses`` or by
    the upload itself), and the archived text. The tables that lead to others go
    after them and the manifest goes last, so an interrupted erasure can simply be
    repeated. ``buckets``, the number the tables are written with, keeps the search
    for rows out of other buckets' folders; versioned tables know theirs.
    """
    uploads = read_if_present(spark, f"{root}/uploads")
    if uploads is None:
        return spark.createDataFrame([], "table_name string, erased long")
    mine = (
        uploads.where(F.col("org_id") == F.lit(org_id)).select(F.col("id").alias("upload_id"))
        .join(ids.select("upload_id").distinct(), "upload_id", "left_semi").distinct().persist()
    )
    analyses = read_if_present(spark, f"{root}/analyses")
    runs = mine.select(F.col("upload_id").alias("analysis_id"))
    if analyses is not None:
        runs = runs.unionByName(analyses.join(mine, "upload_id", "left_semi").select(F.col("id").alias("analysis_id")))
    # Each table is searched and then rewritten by these keys: they are looked up once.
    runs = runs.distinct().persist()
    try:
        return _erase_keys(spark, root, mine, runs, buckets)
    finally:
        runs.unpersist()
        mine.unpersist()


def _erase_keys(spark: SparkSession, root: str, mine: DataFrame, runs: DataFrame, buckets: int | None) -> DataFrame:
    """Remove some uploads and their runs from every table, the manifest last."""
    from proxyspark.sources import versions  # builds on this module

    versioned = versions.VERSIONED if versions.pointer(spark, root) is not None else ()
    counts = [
        (kind, delete_keys(spark, f"{root}/{kind}", kind, keys, buckets))
        for keys, kinds in (
            (mine, ("entries", "entry_rollups", "status_rollups", "bridge", "grants")),
            (runs, ("findings", "vectors", "timings", "status")), (mine, ("analyses",)))
        for kind in kinds if kind not in versioned
    ]
    counts += _erase_archived(spark, root, mine)
    if versioned:
        # Counted and named before the manifest, where ``mine`` comes from, is cut.
        counts += versions.count_rows(spark, root, mine)
        versions.retire(spark, root, spark.createDataFrame(mine.collect(), mine.schema), buckets)
    else:
        counts.append(("uploads", delete_keys(spark, f"{root}/uploads", "uploads", mine.select(F.col("upload_id").alias("id")), buckets)))
    return spark.createDataFrame(counts, "table_name string, erased long")


def _erase_archived(spark: SparkSession, root: str, mine: DataFrame) -> list[tuple]:
    """Raw text, header and places of the files behind some uploads. The file
    listing says which runs hold them, so other runs are not read."""
    kinds = ("archive", "archive_starts", "archive_splits", "archive_files")
    listing = _read_text_partitions(spark, f"{root}/archive_files", ["run"])
    if listing is None:
        return [(kind, 0) for kind in kinds]
    hit = listing.join(mine, "upload_id", "left_semi")
    # At most one name per run of the ingest in which these files came.
    runs = [r[0] for r in hit.select("run").distinct().collect()]
    return [(kind, delete_keys(spark, f"{root}/{kind}", kind, hit.select("file"), runs=runs) if runs else 0) for kind in kinds]


def erase_audit(counts: DataFrame, caller_id, org_id: str, upload_id, now) -> DataFrame:
    """Audit row of one erasure, with what was removed from each table."""
    erased = F.to_json(F.map_from_entries(F.collect_list(F.struct("table_name", "erased"))))
    return counts.agg(erased.alias("detail")).select(
        F.lit(org_id).alias("org_id"), F.lit(caller_id).alias("actor_user_id"), F.lit("upload.deleted").alias("action"),
        F.lit("upload").alias("resource_type"), F.lit(upload_id).alias("resource_id"), "detail",
        F.lit(str(now)).cast("timestamp").alias("created_at"),
    )


def upsert_grants(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Latest grant per (subject, upload), or per (subject, org) when org-wide.

    ``changes`` has an increasing ``seq``; current rows count as older. The
    row keeps the id and creation time it was first given.
    """
    target = F.when(F.col("upload_id").isNull(), F.concat(F.lit("org:"), "org_id")).otherwise(
        F.concat(F.lit("upload:"), F.col("upload_id").cast("string")))
    both = current.withColumn("seq", F.lit(-1).cast("bigint")).unionByName(changes, allowMissingColumns=True)
    keep = ["level", "granted_by", "expires_at"]
    return (
        both.withColumn("_target", target).groupBy("subject_user_id", "_target")
        .agg(
            *[F.min_by(c, "seq").alias(c) for c in ("id", "org_id", "upload_id", "created_at")],
            F.max_by(F.struct(*keep), "seq").alias("_new"),
        )
        .select("id", "org_id", "upload_id", "subject_user_id", *[F.col(f"_new.{c}").alias(c) for c in keep], "created_at")
    )


def valid_status_changes(events: DataFrame) -> DataFrame:
    """Events that a run's state allows: a claim needs queued or running."""
    order = Window.partitionBy("analysis_id").orderBy("event_ts")
    return events.withColumn("_before", F.lag("status").over(order)).where(
        (F.col("status") != "running") | F.coalesce(F.col("_before"), F.lit("queued")).isin("queued", "running")
    ).drop("_before")
