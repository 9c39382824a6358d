"""File-drop ingest: whole log files appearing in a folder."""

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proxyspark.operators.detectors import detect_all
from proxyspark.operators.findings import findings_from_candidates
from proxyspark.plans.ingest import ingest_lines
from proxyspark.sources import logs, tables, versions


def _utc_now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def stream_ingest(spark: SparkSession, source: str, root: str, checkpoint: str, org_id: str, user_id: str,
                  files_per_batch: int = 1000, clock=_utc_now, buckets: int = tables.BUCKETS,
                  analyse: bool = False):
    """Start ingesting files dropped below ``source``; returns the writer to
    ``start`` with a trigger.

    A file is read whole within one micro-batch, so its header is there with
    its rows: drop files by rename. Replaying a batch replaces what it wrote.
    With ``analyse``, uploads of the batch are scored as well.
    """
    lines = (
        spark.readStream.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch)
        .text(source)
        .where(logs.allowed_name(F.col("_metadata.file_path")))
        .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("file_size"),
                F.col("_metadata.file_block_start").alias("split_start"), "value")
    )

    def batch(df: DataFrame, batch_id: int) -> None:
        placed = df.withColumn("pos", F.monotonically_increasing_id())
        ids, _, version = ingest_lines(df.sparkSession, placed, root, org_id, user_id, clock(), f"batch-{batch_id}", buckets=buckets)
        if analyse:
            rescore(df.sparkSession, root, ids, buckets, version)

    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def rescore(spark: SparkSession, root: str, ids: DataFrame, buckets: int = tables.BUCKETS, version: str | None = None) -> None:
    """Score the given uploads from stored entries and replace their findings.

    Only the folders that the pointer names for these uploads are read; with
    ``version``, that of the batch which wrote them, only its own.
    """
    entries = versions.read_committed(spark, root, "entries", ids) if version is None else versions.read_version(
        spark, root, "entries", version)
    if entries is None:
        return
    found = findings_from_candidates(detect_all(entries.join(ids, "upload_id", "left_semi"))).withColumn("analysis_id", F.col("upload_id"))
    tables.replace_rows(found, f"{root}/findings", "findings", "analysis_id",
                        ids.select(F.col("upload_id").alias("analysis_id")), buckets)
