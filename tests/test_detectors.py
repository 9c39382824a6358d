from collections import defaultdict
import math
import statistics

import pytest
from conftest import BASE, MEDIUM, background, entries, entry
from datetime import timedelta

from pyspark.sql import functions as F

from proxyspark import fixed
from proxyspark.fixtures import stored_entries
from proxyspark.operators import detectors, findings, order_stats


def titles(df):
    return {r["title"]: r for r in df.collect()}


def attacks():
    rows = background()
    rows += [entry(10_000 + i, i % 180, client_ip="10.9.9.9", username="bot", host="api.corp.io", req_bytes=280) for i in range(400)]
    rows += [entry(11_000 + i, 3000 + i * 200, client_ip="10.9.9.8", username="chen", host="drop.ru", req_bytes=20_000_000 + i) for i in range(8)]
    rows += [entry(12_000 + i, i * 60 + i % 2, client_ip="10.9.9.7", username="oka", host="beacon.net", req_bytes=412) for i in range(80)]
    rows += [entry(13_000 + i, 500 + i, client_ip="10.9.9.6", username="nov", host="evil.tk", threat_name="Emotet", action="Blocked") for i in range(3)]
    rows += [entry(14_000, 900, client_ip="10.9.9.5", username="riv", host="paste.onion", url="https://paste.onion/x")]
    day = [entry(20_000 + i, (i % 9) * 3600 + i, client_ip=f"10.0.1.{i % 40}", username=f"user{i % 15}", host=f"site{i % 25}.com") for i in range(2000)]
    night = [entry(30_000 + i, -6 * 3600 + i * 60, client_ip="10.9.9.4", username="kim", host="crm.io") for i in range(12)]
    return rows + day + night


def test_background_has_no_finding(spark):
    assert detectors.detect_all(entries(spark, background())).count() == 0


def test_each_detector_finds_its_attack(spark):
    found = {(r["kind"], r["title"]) for r in detectors.detect_all(entries(spark, attacks())).collect()}
    for expected in [
        ("volume_spike", "Request burst from 10.9.9.9"), ("data_exfil", "Large outbound transfer: chen → drop.ru"),
        ("beaconing", "Periodic check-in: 10.9.9.7 → beacon.net"), ("blocked_threat", "Emotet at evil.tk"),
        ("rare_destination", "Rarely-seen destination: paste.onion"), ("off_hours", "Off-hours activity: kim"),
    ]:
        assert expected in found


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_partitioning_does_not_change_results(spark, parts):
    def fingerprint(df):
        cols = ["kind", "title", "entry_count", "candidate_id", "evidence"]
        return sorted((round(r["score"], 10), *[r[c] for c in cols]) for r in detectors.detect_all(df).collect())

    df = entries(spark, attacks())
    assert fingerprint(df.repartition(parts)) == fingerprint(df.coalesce(2))


def test_zero_spread_falls_back_to_deviation(spark):
    rows = [entry(i, i * 60, client_ip=f"10.0.0.{i}") for i in range(60)] + [entry(100 + i, 4000 + i % 20, client_ip="10.1.1.1") for i in range(50)]
    row = detectors.volume_spike(entries(spark, rows)).collect()[0]
    assert row["client_ip"] == "10.1.1.1" and row["entry_count"] >= 20


def test_small_logs_are_not_judged(spark):
    few = entries(spark, [entry(i, i * 60, req_bytes=10) for i in range(4)])
    assert detectors.volume_spike(few).count() == 0
    assert detectors.data_exfil(few).count() == 0
    assert detectors.rare_destination(few).count() == 0
    assert detectors.off_hours(few).count() == 0


def test_beacon_needs_hits_and_regularity(spark):
    regular = [entry(i, i * 60 + i % 2, host="b.net") for i in range(40)]
    short = [entry(100 + i, i * 60, host="few.net") for i in range(5)]
    wild = [entry(200 + i, i * i * 7, host="wild.net") for i in range(40)]
    flood = [entry(300 + i, i, host="flood.net") for i in range(100)]
    once = [entry(500 + i, 50, host="same.net") for i in range(30)]
    df = entries(spark, regular + short + wild + flood + once)
    assert [r["host"] for r in detectors.beaconing(df).collect()] == ["b.net"]
    assert {r["host"] for r in detectors.beaconing(df, min_hits=5).collect()} == {"b.net", "few.net"}


def test_beacon_matches_brute_force(spark):
    rows = [entry(i, (i * 60 + (i * i * 13) % 17) + (0.25 if i % 3 else 0), host=f"h{i % 4}.net") for i in range(400)]
    series = defaultdict(list)
    for r in rows:
        series[r[8]].append(r[5].timestamp())
    want = {}
    for host, times in series.items():
        times.sort()
        gaps = [b - a for a, b in zip(times, times[1:]) if b > a]
        mean = statistics.mean(gaps)
        regularity = 1 - statistics.pstdev(gaps) / mean
        if regularity >= 0.8:
            want[host] = min(1.0, (regularity - 0.8) / 0.18)
    got = {r["host"]: r["score"] for r in detectors.beaconing(entries(spark, rows)).collect()}
    assert got == pytest.approx(want, abs=1e-9)


def test_exfil_matches_brute_force(spark):
    rows = background() + [entry(900 + i, i, username=f"x{i}", host="out.io", req_bytes=10 ** (3 + i)) for i in range(7)]
    logs = [math.log10(r[12]) for r in rows if r[12]]
    median = statistics.median(logs)
    spread = 1.4826 * statistics.median([abs(v - median) for v in logs])
    peaks = defaultdict(float)
    for r in rows:
        peaks[r[7], r[8]] = max(peaks[r[7], r[8]], math.log10(r[12]))
    scores = {f"Large outbound transfer: {u} → {h}": min(1.0, max(0.0, ((p - median) / spread - 3) / 4)) for (u, h), p in peaks.items()}
    best = sorted(((-s, t) for t, s in scores.items() if s >= fixed.MIN_SCORE))[:5]
    got = titles(detectors.data_exfil(entries(spark, rows)))
    assert sorted(got) == sorted(t for _, t in best)
    for s, t in best:
        assert got[t]["score"] == pytest.approx(-s, abs=1e-9)


def test_blocked_threat_collapses_unknown_hosts(spark):
    rows = [entry(i, i, host=None, threat_name="T", username=u, action="Blocked") for i, u in enumerate(["b", "a", None])]
    row = detectors.blocked_threat(entries(spark, rows)).collect()[0]
    assert row["title"] == "T at unknown" and row["score"] == 0.95
    assert row["evidence"]["users"] == ["a", "b"] and row["evidence"]["actions"] == ["Blocked"]


def test_cap_keeps_first_titles(spark):
    rows = [entry(i, i, host=f"h{i}", threat_name="T") for i in range(9)]
    assert sorted(titles(detectors.blocked_threat(entries(spark, rows)))) == [f"T at h{i}" for i in range(5)]


def test_one_hot_pair_changes_nothing(spark):
    """A third of all rows on one pair and one instant."""
    hot = [entry(50_000 + i, 5, client_ip="10.7.7.7", username="hot", host="hot.io") for i in range(1500)]
    kinds = {(r["kind"], r["title"]) for r in detectors.detect_all(entries(spark, attacks() + hot)).collect()}
    assert ("beaconing", "Periodic check-in: 10.9.9.7 → beacon.net") in kinds
    assert not any("hot.io" in t for k, t in kinds if k == "beaconing")


def test_bridge_links_every_cited_row(spark):
    df = entries(spark, attacks())
    candidates = detectors.detect_all(df)
    linked = detectors.finding_entries(candidates, df).groupBy("candidate_id").count()
    counts = {r["candidate_id"]: r["entry_count"] for r in candidates.collect()}
    assert {r["candidate_id"]: r["count"] for r in linked.collect()} == counts


def test_several_scopes_stay_apart(spark):
    two = entries(spark, attacks()).unionByName(entries(spark, [tuple("u2" if v == "u1" else v for v in r) for r in background()]))
    assert {r["upload_id"] for r in detectors.detect_all(two).select("upload_id").distinct().collect()} == {"u1"}


def test_packet_is_bounded_and_drops_samples_first(spark):
    df = entries(spark, attacks())
    candidates = detectors.detect_all(df)
    samples = findings.evidence_rows(detectors.finding_entries(candidates, df), df)
    overview = findings.upload_overview(df)
    import json
    full = json.loads(findings.evidence_packets(candidates, overview, samples).collect()[0]["packet"])
    assert len(full["candidates"]) == candidates.count() and full["candidates"][0]["sample_log_lines"]
    size = 2500
    row = findings.evidence_packets(candidates, overview, samples, max_chars=size).collect()[0]
    small = json.loads(row["packet"])
    assert len(row["packet"]) <= size
    assert not any(c["sample_log_lines"] for c in small["candidates"])
    assert [c["id"] for c in small["candidates"]] == [c["id"] for c in full["candidates"]][: row["candidates_kept"]]

    scope = row["upload_id"]
    given = spark.createDataFrame([(scope, '{"requests":5}')], "upload_id string, baseline_json string")
    with_history = findings.evidence_packets(candidates, overview, samples, baselines=given).collect()[0]
    assert json.loads(with_history["packet"])["organization_baseline"] == {"requests": 5}
    unknown = findings.evidence_packets(candidates, overview, samples, baselines=given.where(F.lit(False))).collect()[0]
    assert json.loads(unknown["packet"]) == full


def test_every_candidate_is_there_without_a_limit(spark):
    rows = [entry(i, i, client_ip="10.0.0.1", username="u", host=f"evil{i}.tk", threat_name="Emotet") for i in range(9)]
    df = entries(spark, rows)
    assert detectors.blocked_threat(df).count() == fixed.MAX_PER_DETECTOR
    assert detectors.blocked_threat(df, per_detector=2).count() == 2
    assert detectors.blocked_threat(df, per_detector=None).count() == 9


def test_fallback_covers_uploads_without_candidates(spark):
    df = entries(spark, background())
    report = findings.fallback_report(detectors.detect_all(df), df.select("upload_id").distinct()).collect()[0]
    assert report["findings"] == 0 and report["overall_risk"] == "low"


def test_accuracy_on_the_seeded_sample(spark):
    from proxyspark.plans.registry import QUERIES
    row = QUERIES["evaluate"](spark, MEDIUM).collect()[0]
    assert row["recall"] == 1.0 and row["false_positives"] == 0 and row["passed"]


def test_quiet_hours_need_sustained_activity(spark):
    day = [entry(i, (i % 9) * 3600 + i, username=f"user{i % 15}") for i in range(1200)]
    one = [entry(9000, -6 * 3600, username="late")]
    assert detectors.off_hours(entries(spark, day + one)).count() == 0
    ten = [entry(9100 + i, -6 * 3600 + i, username="late") for i in range(10)]
    row = detectors.off_hours(entries(spark, day + ten)).collect()[0]
    assert row["actor"] == "late" and row["evidence"]["hours"] == [3]


def test_counts_are_made_once(spark, tmp_path):
    path = str(tmp_path / "entries")
    entries(spark, background()).write.parquet(path)
    rows = spark.read.parquet(path)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the plan as a whole, before it runs
    try:
        for df, scans in (
                (detectors.rare_destination(rows), 2), (detectors.off_hours(rows), 2),  # the counts, and what is cited
                (order_stats.percentiles(rows, [], "latency_ms", {"p50": 0.5}), 1)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert plan.count("FileScan parquet") == scans
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
