"""Streams in event time: one outcome whatever arrives when."""

import random
from datetime import timedelta

import pytest
from conftest import BASE, entries, entry
from pyspark.sql import functions as F

from proxyspark.operators import observability, rollups
from proxyspark.streaming import stateful
from proxyspark.streaming.rollups import keep_rollups, run_available

END = BASE + timedelta(days=900)


@pytest.fixture
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def arriving(spark, path, rows, schema, batches, seed=5):
    """A stream of ``rows`` shuffled over so many files, one per micro-batch."""
    rows = list(rows)
    random.Random(seed).shuffle(rows)
    for i in range(batches):
        spark.createDataFrame(rows[i::batches], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def finish(spark, path, row, schema):
    """A last row from far later lets the watermark pass all others."""
    spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("batches", [1, 2, 7])
def test_alerts_of_shuffled_checks(spark, tmp_path, few_partitions, batches):
    schema = "window_start timestamp, alert string, value double, breached boolean"
    rows = [(BASE + timedelta(minutes=i), f"a{i % 3}", float(i), (i * i) % 7 < 3) for i in range(60)]
    path = str(tmp_path / "in")
    stream = arriving(spark, path, rows, schema, batches)
    finish(spark, path, (END, "end", 0.0, False), schema)
    run_available(stateful.alert_transitions(stream, "2 days"), str(tmp_path / "out"), str(tmp_path / "cp"))
    batch = observability.alert_changes(spark.createDataFrame(rows, schema))
    key = lambda df: sorted((r["window_start"], r["alert"], r["state"]) for r in df.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(batch) and batch.count() > 10


@pytest.mark.parametrize("batches", [1, 7])
def test_timeouts_of_shuffled_beats(spark, tmp_path, few_partitions, batches):
    schema = "analysis_id string, ts timestamp, status string"
    rng = random.Random(2)
    rows, want = [], set()
    for run in range(6):
        at, beats = 0, []
        for _ in range(12):
            at += rng.choice([50, 200, 299, 301, 700])
            beats.append((at, "done" if rng.random() < 0.2 else "running"))
        rows += [(f"r{run}", BASE + timedelta(seconds=s), status) for s, status in beats]
        want |= {(f"r{run}", s) for (s, status), nxt in zip(beats, beats[1:] + [(1e9, "")]) if status == "running" and nxt[0] - s > 300}
    path = str(tmp_path / "in")
    stream = arriving(spark, path, rows, schema, batches)
    finish(spark, path, ("end", END, "done"), schema)
    run_available(stateful.heartbeat_timeouts(stream, watermark="2 days"), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = [(r["analysis_id"], (r["last_seen"] - BASE).total_seconds()) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == sorted(want)


def test_rollups_stay_complete_with_late_rows_and_replays(spark, tmp_path, few_partitions):
    rows = [entry(i, i * 700, upload_id=f"u{i % 3}", host=f"h{i % 4}", latency_ms=(i * 37) % 90 or None, resp_code=404 if i % 9 == 0 else 200) for i in range(400)]
    rows.append(entry(999, ts=None))
    df = entries(spark, rows)
    schema = df.schema
    path, root = str(tmp_path / "in"), str(tmp_path / "root")
    stream = arriving(spark, path, rows, schema, 3)
    keep_rollups(stream, root, str(tmp_path / "cp"), buckets=2).trigger(availableNow=True).start().awaitTermination()
    want = rollups.entry_rollups(df, "minute")
    read = lambda: sorted(map(str, spark.read.parquet(f"{root}/live_rollups").select(want.columns).collect()))
    assert read() == sorted(map(str, want.collect()))
    # A row from weeks ago, and a batch that is run again.
    late = [entry(1000, 5, upload_id="u0", host="h0", latency_ms=1)]
    spark.createDataFrame(late, schema).coalesce(1).write.mode("append").parquet(path)
    keep_rollups(stream, root, str(tmp_path / "cp"), buckets=2).trigger(availableNow=True).start().awaitTermination()
    want = rollups.entry_rollups(entries(spark, rows + late), "minute")
    assert read() == sorted(map(str, want.collect()))
    touched = [(r[0], str(r[1])) for r in spark.read.parquet(f"{root}/live_cells/batch=3").select(F.col("day").cast("string"), "bucket").distinct().collect()]
    assert len(touched) == 1
