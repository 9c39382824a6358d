from datetime import datetime, timedelta

import pandas as pd
import pytest
from conftest import BASE, entries, entry
from pyspark.sql import functions as F

from proxyspark import fixed
from proxyspark.operators import access, dashboard, rollups, scope, search
from proxyspark.operators.scope import Caller, Scope
from proxyspark.sources import tables

NOW = datetime(2024, 6, 1)
PAST, AHEAD = NOW - timedelta(days=1), NOW + timedelta(days=1)
OWNER, PEER, ADMIN, OUTSIDER = (Caller("own", "o1"), Caller("peer", "o1"), Caller("adm", "o1", "admin"), Caller("out", "o2", "owner"))


def tenancy(spark, *grants):
    users = spark.createDataFrame(
        [(c.id, c.org_id, f"{c.id}@X.io", c.role, NOW) for c in (OWNER, PEER, ADMIN, OUTSIDER)],
        "id string, org_id string, email string, role string, created_at timestamp")
    uploads = spark.createDataFrame(
        [("up", "o1", "own", "a.log", NOW), ("other", "o1", "adm", "b.log", PAST)],
        "id string, org_id string, user_id string, filename string, created_at timestamp")
    rows = [(f"g{i}", "o1", up, who, level, "own", until, NOW) for i, (up, who, level, until) in enumerate(grants)]
    return users, uploads, spark.createDataFrame(
        rows, "id string, org_id string, upload_id string, subject_user_id string, level string, granted_by string, "
              "expires_at timestamp, created_at timestamp")


LEVELS = [
    ("own", [], "full"), ("peer", [], None), ("adm", [], "dashboard"), ("out", [], None),
    ("peer", [("up", "peer", "summary", None)], "summary"), ("peer", [("up", "peer", "full", PAST)], None),
    ("peer", [("up", "peer", "full", AHEAD)], "full"), ("peer", [(None, "peer", "dashboard", None)], "dashboard"),
    ("peer", [("up", "peer", "summary", None), (None, "peer", "full", None)], "full"),
    ("peer", [("other", "peer", "full", None)], None), ("adm", [("up", "adm", "full", None)], "full"),
    ("adm", [("up", "adm", "summary", None)], "dashboard"), ("out", [("up", "out", "full", None)], None),
]


def test_level_matrix_and_listing_agree(spark):
    for who, grants, want in LEVELS:
        users, uploads, held = tenancy(spark, *grants)
        asked = spark.createDataFrame([(who, "up")], "user_id string, upload_id string")
        row = access.resolve_levels(asked, users, uploads, held, NOW).collect()[0]
        assert row["level"] == want, (who, grants)
        caller = {c.id: c for c in (OWNER, PEER, ADMIN, OUTSIDER)}[who]
        listed = [r["id"] for r in access.visible_uploads(caller, uploads, held, NOW).collect()]
        assert ("up" in listed) == (want is not None), (who, grants)


def test_break_glass_is_audited(spark):
    users, uploads, held = tenancy(spark, ("up", "peer", "summary", None))
    asked = spark.createDataFrame([(u, "up") for u in ("own", "peer", "adm", "out")], "user_id string, upload_id string")
    outcomes = access.require_level(access.resolve_levels(asked, users, uploads, held, NOW), "full")
    assert {r["user_id"]: r["outcome"] for r in outcomes.collect()} == {
        "own": "granted", "peer": "forbidden", "adm": "breakglass", "out": "not_found"}
    audit = access.breakglass_audit(outcomes, NOW).collect()
    assert len(audit) == 1 and audit[0]["actor_user_id"] == "adm" and '"granted_level":"dashboard"' in audit[0]["detail"]


def test_grants_are_replaced_per_target(spark):
    *_, held = tenancy(spark, ("up", "peer", "summary", None), (None, "peer", "summary", None))
    changes = held.select("org_id", "upload_id", "subject_user_id", F.lit("full").alias("level"), "granted_by",
                          "expires_at", "created_at", F.lit("new").alias("id"), F.lit(1).cast("long").alias("seq")).where("upload_id IS NULL")
    out = {(r["upload_id"], r["level"], r["id"]) for r in tables.upsert_grants(held, changes).collect()}
    assert out == {("up", "summary", "g0"), (None, "full", "g1")}


def test_lists_and_masks(spark):
    users, uploads, held = tenancy(spark, ("up", "peer", "summary", None), ("other", "adm", "full", None))
    assert access.list_grants(ADMIN, held).count() == 2
    assert [r["id"] for r in access.list_grants(PEER, held).collect()] == ["g0"]
    assert [r["id"] for r in access.find_by_email(users, "PEER@x.IO").collect()] == ["peer"]
    with pytest.raises(PermissionError):
        access.list_audit(PEER, held, users)
    found = spark.createDataFrame([("f", "up", [1, 2])], "id string, upload_id string, entry_ids array<long>")
    levels = spark.createDataFrame([("up", 2)], "upload_id string, level_rank int")
    assert access.mask_entry_ids(found, levels).collect()[0]["entry_ids"] is None
    assert access.mask_entry_ids(found, levels.withColumn("level_rank", F.lit(3))).collect()[0]["entry_ids"] == [1, 2]


def test_redaction(spark):
    df = entries(spark, [entry(1)])
    out = access.redact(df, {"username": "u_"}, "salt")
    assert not set(out.columns) & set(fixed.FORBIDDEN_FIELDS)
    assert out.collect()[0]["username_hash"].startswith("u_") and len(out.collect()[0]["username_hash"]) == 14
    with pytest.raises(ValueError):
        access.redact(df, {"username": "u_"})


def test_scope_rules():
    now = datetime(2024, 6, 1)
    mine = scope.scope_for(PEER, now)
    assert (mine.user_id, mine.start, mine.end) == ("peer", now - timedelta(days=30), now + timedelta(minutes=1))
    assert scope.scope_for(ADMIN, now, org_wide=True).user_id is None
    assert scope.scope_for(PEER, now, "2024-05-01T02:00:00+02:00").start == datetime(2024, 5, 1)
    with pytest.raises(PermissionError):
        scope.scope_for(PEER, now, org_wide=True)
    for bad in ({"start": "yesterday"}, {"start": now, "end": now - timedelta(days=1)}):
        with pytest.raises(ValueError):
            scope.scope_for(PEER, now, **bad)
    assert scope.analysis_scope("file", 9) == ("file", None) and scope.analysis_scope("history", None) == ("history", 30)
    with pytest.raises(ValueError):
        scope.analysis_scope("history", 366)


def test_empty_window_still_gives_a_summary(spark):
    df = entries(spark, [entry(1, latency_ms=5)])
    uploads = spark.createDataFrame([("u1", "o1", "owner", NOW)], "id string, org_id string, user_id string, created_at timestamp")
    hours = rollups.entry_rollups(df, "hour")
    quiet = Scope("o1", datetime(2020, 1, 1), datetime(2020, 2, 1))
    row = dashboard.dashboard_summary(hours, df, uploads, quiet).collect()[0]
    assert row["requests"] == 0 and row["success_rate"] is None and row["latency_p50"] is None and row["empty"]
    assert row["data_start"] == BASE
    foreign = dashboard.dashboard_summary(hours, df, uploads, Scope("o9", datetime(2024, 1, 1), datetime(2025, 1, 1))).collect()[0]
    assert foreign["data_start"] is None and foreign["requests"] == 0
    with pytest.raises(ValueError):
        dashboard.top_n(df, quiet, "raw; drop table")


def test_month_column_prunes_partitions(spark, tmp_path):
    tables.write_entries(entries(spark, [entry(1), entry(2, 86400 * 40)]), str(tmp_path / "e"), 2)
    stored = spark.read.parquet(str(tmp_path / "e"))
    march = scope.apply_scope(stored, Scope("o1", datetime(2024, 3, 1), datetime(2024, 3, 31)))
    plan = march._jdf.queryExecution().executedPlan().toString()
    assert "month" in plan.split("PartitionFilters")[1].split("]")[0] and march.count() == 1


FINDINGS = [
    ("f1", "data_exfil", "Uploads to cdn-telemetry-sync.net kept growing", "Block the host", 0.9),
    ("f2", "beaconing", "Periodic check-ins seen by the proxy", "Isolate the machine", 0.8),
    ("f3", "off_hours", "Host sync traffic at night, telemetry unknown", "Review", 0.7),
]


def hits(spark, query):
    df = spark.createDataFrame(FINDINGS, "id string, kind string, explanation string, recommendation string, confidence double")
    return [r["finding_id"] for r in search.search_findings_text(search.build_finding_index(df), df, query).collect()]


def test_text_search(spark):
    assert hits(spark, "telemetry sync") == ["f1", "f3"]
    assert hits(spark, "cdn-telemetry-sync.net") == ["f1"]
    assert set(hits(spark, "beaconing or uploading")) == {"f1", "f2"}
    # Words at the phrase's distances; "ins" keeps the plain form from matching.
    assert hits(spark, '"check-in seen"') == ["f2"]
    assert hits(spark, '"seen check-in"') == []
    # The plain form of a query counts every word, quoted or excluded alike.
    assert hits(spark, '"telemetry sync"') == ["f1", "f3"]
    assert hits(spark, "telemetry -nights") == ["f1"]
    assert set(hits(spark, "telemetry -night")) == {"f1", "f3"}
    assert set(hits(spark, "-nights")) == {"f1", "f2"}
    assert hits(spark, "the machines") == ["f2"]
    assert hits(spark, "nothing here") == []
    for bad in ("", " ", "x" * 501):
        with pytest.raises(ValueError):
            search.parse_query(bad)


def test_vector_search_matches_brute_force(spark):
    vectors = {f"v{i}": [float((i * k) % 7 - 3) for k in range(1, 9)] for i in range(1, 30)}
    df = spark.createDataFrame([(k, v) for k, v in vectors.items()], "finding_id string, embedding array<float>")
    probe = [1.0, 0.5, -1.0, 2.0, 0.0, 1.0, 1.0, -2.0]
    norm = lambda v: sum(x * x for x in v) ** 0.5
    cos = {k: sum(a * b for a, b in zip(v, probe)) / norm(v) / norm(probe) for k, v in vectors.items() if norm(v)}
    want = sorted(cos, key=lambda k: (-round(cos[k], 12), k))[:5]
    got = search.search_findings_vector(df, probe, 5).collect()
    assert [round(r["rank"], 9) for r in got] == [round(cos[k], 9) for k in want]


def test_embedding_needs_a_provider(spark):
    texts = spark.createDataFrame([("a", "text")], "id string, content string")
    assert search.embed_findings(texts).count() == 0

    @F.pandas_udf("array<float>")
    def lengths(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [float(len(t))] * 4)

    assert search.embed_findings(texts, lengths, dims=4).count() == 1
    assert search.embed_findings(texts, lengths, dims=1024).count() == 0
    assert search.rejected_vectors(texts, lengths, dims=4).count() == 0
    assert [r["size"] for r in search.rejected_vectors(texts, lengths, dims=1024).collect()] == [4]


def test_search_shows_only_what_the_caller_may_see(spark):
    vectors = spark.createDataFrame([(f"f{i}", [1.0, float(i)]) for i in range(4)], "finding_id string, embedding array<float>")
    findings = spark.createDataFrame([(f"f{i}", f"a{i}") for i in range(4)], "id string, analysis_id string")
    analyses = spark.createDataFrame([(f"a{i}", f"u{i}") for i in range(4)], "id string, upload_id string")
    uploads = spark.createDataFrame(
        [("u0", "o1", "me", "x"), ("u1", "o1", "you", "x"), ("u2", "o1", "you", "x"), ("u3", "o2", "me", "x")],
        "id string, org_id string, user_id string, filename string")
    grants = spark.createDataFrame(
        [("u1", "o1", "me", None), ("u2", "o1", "me", datetime(2020, 1, 1))],
        "upload_id string, org_id string, subject_user_id string, expires_at timestamp")
    now = datetime(2024, 1, 1)

    def found(caller):
        hits = search.search_visible_vector(vectors, findings, analyses, uploads, grants, caller, now, [1.0, 0.0])
        return [r["finding_id"] for r in hits.collect()]

    assert found(Caller("me", "o1", "member")) == ["f0", "f1"]
    assert found(Caller("boss", "o1", "admin")) == ["f0", "f1", "f2"]
    assert found(Caller("you", "o2", "member")) == []
