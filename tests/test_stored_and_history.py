"""Stored dashboards, sketches, address keys and baselines of many runs."""

import ipaddress
from datetime import datetime, timedelta

import pytest
from conftest import BASE, background, entries, entry
from pyspark.sql import functions as F

from proxyspark.fixtures import manifest_of
from proxyspark.functions import net
from proxyspark.operators import dashboard, history, rollups, sketches
from proxyspark.operators.scope import Scope
from proxyspark.plans import ingest
from proxyspark.plans.stored import StoredDashboards
from proxyspark.sources import versions

DAY = Scope("o1", datetime(2024, 3, 14), datetime(2024, 3, 15))


@pytest.fixture
def whole_plans(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def scans(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [p.split("ReadSchema")[0] for p in plan.split("FileScan parquet")[1:]]


def test_stored_dashboards_read_only_their_folders(spark, tmp_path, whole_plans):
    root = str(tmp_path / "root")
    df = entries(spark, background() + [entry(9000, -86400 * 60, upload_id="u2", latency_ms=3), entry(9001, ts=None)])
    ingest.store(spark, root, df, manifest_of(df), "v1", 2)
    stored = StoredDashboards(spark, root)
    hours = rollups.entry_rollups(df, "hour")
    assert stored.summary(DAY).drop("uploads").collect() == dashboard.dashboard_summary(
        hours, df, manifest_of(df), DAY).drop("uploads").collect()
    assert stored.series(DAY, "minute").collect() == dashboard.dashboard_series(rollups.entry_rollups(df, "minute"), df, DAY, "minute").collect()
    assert stored.status(DAY).collect() == dashboard.status_breakdown(rollups.status_rollups(df), DAY).collect()
    assert stored.span(DAY).collect() == dashboard.data_span(hours, DAY).collect()
    grain = [s for s in scans(stored.series(DAY)) if "entry_rollups" in s]
    assert grain and all("(grain" in s.split("PartitionFilters")[1] and "GreaterThanOrEqual(bucket_start" in s for s in grain)
    rows = [s for s in scans(stored.series(DAY)) if "/entries" in s]
    assert rows and all("(month" in s.split("PartitionFilters: [")[1].split("]")[0] for s in rows)
    assert not [s for s in scans(stored.sketched(DAY, ["upload_id"])) if "/entries" in s]
    subnet = stored.in_subnet(DAY, "10.0.1.0/28")
    assert subnet.count() == df.where(net.ip_in_cidr(F.col("client_ip"), "10.0.1.0/28")).count() > 0
    assert any("PushedFilters" in s and "GreaterThanOrEqual(ip_key" in s for s in scans(subnet))


def test_address_keys_sort_as_addresses(spark):
    texts = ["0.0.0.0", "10.0.0.9", "10.0.0.10", "255.255.255.255", "::", "::1", "::ffff:1.2.3.4", "2001:db8::5", "fe80::1%eth0", "ffff::"]
    df = spark.createDataFrame([(t,) for t in [*texts, None, "x"]], "ip string").withColumn("key", net.ip_key(F.col("ip")))
    got = {r["ip"]: r["key"] for r in df.collect()}
    order = lambda t: (lambda a: (a.version, int(a)))(ipaddress.ip_address(t.split("%")[0]))
    assert sorted(texts, key=lambda t: bytes(got[t])) == sorted(texts, key=order)
    assert got[None] is None and got["x"] is None
    for cidr in ("10.0.0.8/29", "0.0.0.0/0", "::/0", "2001:db8::/32", "10.0.0.10/32"):
        inside = {r[0] for r in df.where(net.key_in_cidr(F.col("key"), cidr)).collect()}
        network = ipaddress.ip_network(cidr)
        assert inside == {t for t in texts if ipaddress.ip_address(t.split("%")[0]) in network}


def test_merged_sketches_keep_ranks(spark):
    rows = [entry(i, i % 86000, upload_id=f"u{i % 2}", latency_ms=(i * i) % 3001, org_id="o1") for i in range(6000)] + [entry(-1, ts=None, latency_ms=5), entry(-2)]
    df = entries(spark, rows)
    scope = Scope("o1", BASE - timedelta(days=1), BASE + timedelta(days=2))
    found = sketches.sketched_latency(sketches.latency_sketches(df), scope, ["upload_id"])
    errors = sketches.rank_errors(found, df, scope, ["upload_id"]).collect()
    assert {r["upload_id"]: r["observations"] for r in errors} == {"u0": 3000, "u1": 3000}
    assert all(r[f"{n}_error"] <= 0.03 for r in errors for n in sketches.FRACTIONS)
    assert sketches.latency_sketches(df.limit(0)).count() == 0


def test_baselines_of_many_runs_equal_one_at_a_time(spark):
    rows = []
    for i in range(1500):
        rows.append(entry(i, (i * 977) % 2_000_000, org_id=f"o{i % 5 % 2}", upload_id=f"u{i % 7}", host=f"h{(i * i) % 11 + (i % 7 == 0) * 100}",
                          resp_code=404 if i % 9 == 0 else 200))
    rows += [entry(5000 + i, 1_000_000 + i % 60, org_id="o0", upload_id="u1", host="busy") for i in range(300)]
    hours = rollups.entry_rollups(entries(spark, rows), "hour")
    start = BASE + timedelta(days=20)
    runs = [(f"r{k}", f"o{k % 3}", f"u{k % 9}", start + timedelta(hours=31 * (k % 11) - 200, minutes=k), 1 + k % 25 if k % 10 else None) for k in range(40)]
    got = {r["run_id"]: tuple(r)[1:] for r in history.history_baselines(hours, spark.createDataFrame(
        runs, "id string, org_id string, upload_id string, created_at timestamp, baseline_window_days int")).collect()}
    plain = [r.asDict() for r in hours.collect()]
    want = {}
    for name, org, own, at, days in runs:
        if days is None:
            continue
        kept = [r for r in plain if r["org_id"] == org and r["upload_id"] != own and r["bucket_start"] >= at - timedelta(days=days)]
        counts = sorted(r["requests"] for r in kept)
        want[name] = (days, sum(counts), sum(r["errors"] for r in kept), len({r["host"] for r in kept}),
                      float(counts[(len(counts) + 1) // 2 - 1]) if counts else 0.0)
    assert got == want and len({w[1] for w in want.values()}) > 5
    one = rollups.org_baseline(hours, "o1", 7, "u1", start).collect()[0]
    same = history.history_baselines(hours, spark.createDataFrame([("x", "o1", "u1", start, 7)], "id string, org_id string, upload_id string, created_at timestamp, baseline_window_days int")).collect()[0]
    assert tuple(one) == tuple(same)[1:]


def test_pages_after_a_key_are_the_pages_by_offset(spark, tmp_path, whole_plans):
    root = str(tmp_path / "root")
    rows = [entry(100 + k, k, line_no=k // 3 + 1) for k in range(23)] + [entry(900 + k, k, line_no=None) for k in range(4)]
    df = entries(spark, rows + [entry(9000, 1, upload_id="u2")])
    ingest.store(spark, root, df, manifest_of(df), "v1", 2)
    stored, mine = StoredDashboards(spark, root), "u1"
    flagged = df.where("line_no = 3 OR line_no IS NULL").select("upload_id", F.col("id").alias("entry_id"))
    for flagged_only in (False, True):
        got, after = [], None
        while True:
            page = stored.page(mine, flagged, limit=4, flagged_only=flagged_only, after=after).collect()
            want = dashboard.entry_page(df, flagged, mine, limit=4, offset=len(got), flagged_only=flagged_only).collect()
            assert [(r["line_no"], r["id"], r["anomalous"]) for r in page] == [(r["line_no"], r["id"], r["anomalous"]) for r in want]
            if not page:
                break
            got += page
            after = (page[-1]["line_no"], page[-1]["id"])
        assert len(got) == (7 if flagged_only else 27)
    scan = [s for s in scans(stored.page(mine, flagged, after=(5, 100))) if "/entries" in s]
    assert scan and all("bucket" in s.split("PartitionFilters: [")[1].split("]")[0] and "GreaterThanOrEqual(line_no,5)" in s for s in scan)
    assert stored.page("nowhere", flagged).count() == 0


def test_a_page_cut_by_offset_is_in_line_order(spark):
    df = entries(spark, [entry(100 + k, k, line_no=k // 3 + 1) for k in range(23)])
    flagged = df.where("line_no = 3").select("upload_id", F.col("id").alias("entry_id"))
    for offset in (4, 8, 12):
        page = dashboard.entry_page(df, flagged, "u1", limit=4, offset=offset).collect()
        assert [r["id"] for r in page] == list(range(100 + offset, 104 + offset))
