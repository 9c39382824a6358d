import math
from datetime import datetime, timedelta

import pytest
from conftest import BASE, entries, entry
from pyspark.sql import functions as F

from proxyspark import fixed
from proxyspark.operators import observability, order_stats, rollups
from proxyspark.sources import logs
from proxyspark.streaming import stateful
from proxyspark.streaming.ingest import stream_ingest
from proxyspark.streaming.rollups import run_available, stream_rollups

METRIC = "ts timestamp, seq long, name string, type string, labels map<string,string>, value double"


def metrics(spark, rows):
    return spark.createDataFrame(rows, METRIC)


def latency(n, value, start=0):
    return [(BASE + timedelta(seconds=start), start + i, "http.latency_ms", "histogram", {"b": "1", "a": "2"}, value) for i in range(n)]


def test_histogram_keeps_the_last_samples(spark):
    rows = [(BASE, i, "h", "histogram", {}, float(i)) for i in range(600)]
    row = observability.metric_histograms(metrics(spark, rows)).collect()[0]
    kept = [float(i) for i in range(88, 600)]
    rank = lambda p: kept[max(1, min(512, round(p * 512))) - 1]
    assert (row["count"], row["min"], row["max"]) == (512, 88.0, 599.0)
    assert (row["p50"], row["p95"], row["p99"]) == (rank(0.5), rank(0.95), rank(0.99))


def test_labels_ignore_order_and_gauges_add_up(spark):
    rows = [(BASE, 1, "c", "counter", {"a": "1", "b": "2"}, 1.0), (BASE, 2, "c", "counter", {"b": "2", "a": "1"}, 2.0),
            (BASE, 3, "g", "gauge", {}, 5.0), (BASE, 4, "g", "gauge_delta", {}, 2.0), (BASE, 5, "g", "gauge_delta", {}, -1.0),
            (BASE, 2, "g", "gauge_delta", {}, 9.0)]
    df = metrics(spark, rows)
    assert {(r["labels"], r["value"]) for r in observability.metric_counters(df).collect()} == {("a=1,b=2", 3.0), (None, 3.0)}
    assert observability.metric_gauges(df).collect()[0]["value"] == 6.0


def test_alerts_need_samples_and_fire_once(spark):
    few = observability.evaluate_alerts(metrics(spark, latency(3, 9000.0)))
    assert few.count() == 0
    many = metrics(spark, latency(20, 9000.0) + latency(20, 9000.0, 60) + latency(20, 10.0, 120) + latency(20, 10.0, 180))
    changes = observability.alert_changes(observability.evaluate_alerts(many)).orderBy("window_start").collect()
    assert [(r["alert"], r["state"]) for r in changes] == [("http_latency_p95", "firing"), ("http_latency_p95", "resolved")]


def test_ratios_without_data_are_null(spark):
    row = observability.derived_ratios(metrics(spark, [(BASE, 1, "x", "counter", {}, 1.0)])).collect()[0]
    assert all(v is None for v in row)


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_order_statistics_match_brute_force(spark, parts):
    import math
    import statistics
    values = [((i * 7919) % 1009) / 7 - 40 for i in range(3000)] + [5.0] * 1500
    df = spark.createDataFrame([("k", v) for v in values], "k string, v double").repartition(parts)
    ordered = sorted(values)
    got = order_stats.percentiles(df, ["k"], "v", {"p1": 0.01, "p50": 0.5, "p99": 0.99}).collect()[0]
    for name, p in (("p1", 0.01), ("p50", 0.5), ("p99", 0.99)):
        assert got[name] == ordered[math.ceil(p * len(ordered)) - 1]
    base = order_stats.robust_baseline(order_stats.value_counts(df, ["k"], "v"), ["k"], "v").collect()[0]
    median = statistics.median(values)
    assert base["median"] == pytest.approx(median)
    assert base["spread"] == pytest.approx(1.4826 * statistics.median([abs(v - median) for v in values]))


def files(spark, df, path):
    df.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.fixture
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_stream_rollups_equal_batch(spark, tmp_path, few_partitions):
    rows = [entry(i, i * 40, latency_ms=i % 50, resp_code=404 if i % 9 == 0 else 200) for i in range(400)]
    df = entries(spark, rows)
    stream = files(spark, df, str(tmp_path / "in"))
    run_available(stream_rollups(stream, watermark="10 minutes"), str(tmp_path / "out"), str(tmp_path / "cp"))
    end = BASE + timedelta(seconds=399 * 40) - timedelta(minutes=10)
    batch = rollups.entry_rollups(df, "minute").where(F.col("bucket_start") + F.expr("INTERVAL 1 MINUTE") <= F.lit(str(end)).cast("timestamp"))
    got = spark.read.parquet(str(tmp_path / "out")).select(batch.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, batch.collect())) and got.count() > 0


def test_ranks_of_tiny_values_are_split(spark):
    values = [i * 1e-9 for i in range(1, 2001)] + [-i * 1e-9 for i in range(1, 2001)] + [0.0, float("inf"), 1e300, -1e300]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = order_stats.percentiles(df, [], "v", {"p1": 0.01, "p50": 0.5, "p99": 0.99, "p100": 1.0}).collect()[0]
    ordered = sorted(values)
    assert [got[k] for k in ("p1", "p50", "p99", "p100")] == [ordered[math.ceil(len(values) * p) - 1] for p in (0.01, 0.5, 0.99, 1.0)]
    assert df.select(order_stats._bucket(F.col("v"))).distinct().count() > 1000


def throttle(events):
    """Brute force over events in time order: (id, dimension) -> (failures, blocked)."""
    out, state = {}, {}
    for i, ts, ip, account, ok in sorted(events, key=lambda e: e[1]):
        at = ts.timestamp()
        for dim, key, limit, window in (("ip", ip, 20, 300), ("account", account.strip().lower(), 10, 1800)):
            s = state.setdefault((dim, key), {"n": 0, "t": 0.0, "lock": 0.0})
            if s["n"] and at >= s["t"] + window:
                s["n"] = 0
            blocked = s["n"] >= limit if dim == "ip" else at < s["lock"]
            if blocked:
                pass
            elif ok and dim == "account":
                s.update(n=0, lock=0.0)
            elif not ok:
                s["t"] = at if s["n"] == 0 else s["t"]
                s["n"] += 1
                if dim == "account" and s["n"] >= limit:
                    s["lock"] = at + 900
            out[i, dim] = (s["n"], blocked)
    return out


def test_login_throttle_matches_brute_force(spark, tmp_path, few_partitions):
    events = [(i, BASE + timedelta(seconds=i * 7 + (i % 5)), f"10.0.0.{i % 2}", f" User{i % 3}@x.io", i % 37 == 0) for i in range(600)]
    schema = "id long, ts timestamp, ip string, account string, success boolean"
    path = str(tmp_path / "in")
    files(spark, spark.createDataFrame(events[:300], schema), path)
    stream = files(spark, spark.createDataFrame(events[300:], schema), path)
    run_available(stateful.login_throttle(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(r["id"], r["dimension"]): (r["failures"], r["blocked"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = throttle(events)
    assert got == want and any(b for _, b in want.values())


def test_alert_transitions_match_batch(spark, tmp_path, few_partitions):
    rows = [(BASE + timedelta(minutes=i), f"a{i % 3}", float(i), i % 7 < 3) for i in range(90)]
    schema = "window_start timestamp, alert string, value double, breached boolean"
    path = str(tmp_path / "in")
    files(spark, spark.createDataFrame(rows[:45], schema), path)
    stream = files(spark, spark.createDataFrame(rows[45:], schema), path)
    run_available(stateful.alert_transitions(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    batch = observability.alert_changes(spark.createDataFrame(rows, schema))
    key = lambda df: sorted((r["window_start"], r["alert"], r["state"]) for r in df.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(batch)


def test_silent_runs_are_queued_again(spark, tmp_path, few_partitions):
    beat = lambda run, s, status="running": (run, BASE + timedelta(seconds=s), status)
    rows = [beat("gone", 0), beat("gone", 100), beat("gap", 0), beat("gap", 1000), beat("ok", 0), beat("ok", 50, "done"),
            *[beat("alive", s) for s in range(0, 4000, 100)], beat("gap", 1100, "done")]
    stream = files(spark, spark.createDataFrame(rows, "analysis_id string, ts timestamp, status string"), str(tmp_path / "in"))
    run_available(stateful.heartbeat_timeouts(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(r["analysis_id"], (r["last_seen"] - BASE).total_seconds()) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("gone", 100.0), ("gap", 0.0)}


def test_stream_ingest_scores_touched_uploads(spark, tmp_path, few_partitions):
    drop, root = tmp_path / "drop", str(tmp_path / "root")
    drop.mkdir()
    rows = [f"2024-03-14 09:{i // 60 % 60:02d}:{i % 60:02d},10.0.0.{i % 30},u{i % 9},h{i % 6}.io," for i in range(300)]
    (drop / "a.csv").write_text("datetime,ClientIP,login,host,threatname\n" + "\n".join(rows + ["2024-03-14 10:00:00,10.0.0.9,u1,evil.tk,Emotet"]) + "\n")
    writer = lambda: stream_ingest(spark, str(drop), root, str(tmp_path / "cp"), "o1", "own", clock=lambda: datetime(2024, 6, 1), buckets=2, analyse=True)
    writer().trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(f"{root}/entries").count() == 301
    kinds = {r["kind"] for r in spark.read.parquet(f"{root}/findings").collect()}
    assert "blocked_threat" in kinds
    (drop / "b.csv").write_text("datetime,ClientIP\n2024-03-15 09:00:00,10.0.0.1\n")
    writer().trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(f"{root}/entries").count() == 302 and spark.read.parquet(f"{root}/uploads").count() == 2
