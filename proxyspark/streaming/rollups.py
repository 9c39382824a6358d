"""Rollups kept up to date from a stream of canonical entries."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proxyspark.functions import labels
from proxyspark.operators import rollups
from proxyspark.sources import tables

_KEYS = ["org_id", "user_id", "upload_id", "host"]


def stream_rollups(entries: DataFrame, grain: str = "minute", watermark: str = "1 hour") -> DataFrame:
    """Tumbling rollups in append mode: a bucket appears once its window has
    passed the watermark. Rows later than that are dropped, and counted by
    Spark in ``numRowsDroppedByWatermark``.

    A bucket's percentiles are exact; its state holds the bucket's distinct
    latencies, so keep this to short grains.
    """
    pct = lambda p: F.expr(f"CAST(percentile_disc({p}) WITHIN GROUP (ORDER BY latency_ms) AS INT)")
    timed = entries.where(F.col("ts").isNotNull()).withColumn("host", F.coalesce("host", F.lit("")))
    grouped = timed.withWatermark("ts", watermark).groupBy(F.window("ts", f"1 {grain}").alias("w"), *_KEYS).agg(
        F.count(F.lit(1)).alias("requests"),
        F.coalesce(F.sum("resp_bytes"), F.lit(0)).alias("bytes_in"),
        F.coalesce(F.sum("req_bytes"), F.lit(0)).alias("bytes_out"),
        F.count_if(labels.is_error(F.col("resp_code"))).alias("errors"),
        F.count_if(labels.is_cache_hit(F.col("cache_status"))).alias("cache_hits"),
        F.count("cache_status").alias("cache_total"),
        pct(0.5).alias("latency_p50"), pct(0.95).alias("latency_p95"), pct(0.99).alias("latency_p99"),
        F.count("latency_ms").alias("latency_count"),
    )
    return grouped.select(
        *_KEYS, F.lit(grain).alias("grain"), F.col("w.start").alias("bucket_start"),
        *[c for c in grouped.columns if c not in ("w", *_KEYS)])


_CELLS = ["day", "bucket"]


def keep_rollups(entries: DataFrame, root: str, checkpoint: str, grain: str = "minute", buckets: int = tables.BUCKETS):
    """Start-able writer that keeps ``live_rollups`` below ``root`` complete: after each
    micro-batch every bucket has its exact figures, whenever its rows came.

    A batch adds its cells (counters and value counts per minute, by day and hash bucket
    of the upload) as a folder of its own, which a replay overwrites. The (day, bucket)
    parts that it touched are then rolled up again from all stored cells of these parts
    and replaced; no log row is read twice, and other parts are not read. Percentiles
    stay exact, as cells keep each value's count. Rows without a time are in no bucket.
    """
    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        cells = rollups._cells(df).withColumns({
            "day": F.date_format("bucket_start", "yyyy-MM-dd"), "bucket": tables._bucket("upload_id", buckets)})
        path = f"{root}/live_cells/batch={batch_id}"
        cells.hint("rebalance", *[F.col(c) for c in _CELLS]).write.mode("overwrite").partitionBy(*_CELLS).parquet(path)
        added = tables.read_if_present(spark, path)
        if added is None:
            return
        # At most one pair per day and bucket.
        touched = [tuple(map(str, r)) for r in added.select(*[F.col(c).cast("string") for c in _CELLS]).distinct().collect()]
        refresh(spark, root, grain, touched)

    return entries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def refresh(spark: SparkSession, root: str, grain: str, parts: list[tuple]) -> None:
    """Roll up some (day, bucket) parts again from the cells stored for them."""
    stored = tables._read_text_partitions(spark, f"{root}/live_cells", ["batch", *_CELLS])
    cells = tables._in_partitions(stored, _CELLS, {(d, int(b)) for d, b in parts}).drop("batch")
    # A part's cells give only rollups of that part: hours do not cross days.
    rolled = rollups.rollups_of_cells(cells.drop(*_CELLS), grain).withColumn("day", F.date_format("bucket_start", "yyyy-MM-dd"))
    where = cells.select("upload_id", "bucket").distinct()
    rolled.join(where, "upload_id").hint("rebalance", *[F.col(c) for c in _CELLS]).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy(*_CELLS).parquet(f"{root}/live_rollups")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Process what is there, write Parquet, stop."""
    started = (
        stream.writeStream.outputMode(mode).format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    started.awaitTermination()
    return started
