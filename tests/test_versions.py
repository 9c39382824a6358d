"""Replacement by versions: what a reader sees between any two writes."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from proxyspark.plans.ingest import ingest_files
from proxyspark.sources import tables, versions
from proxyspark.streaming.ingest import rescore

NOW = datetime(2024, 6, 1)
HEAD = "datetime,ClientIP,login,host,requestsize,respcode"


def drop(folder, name, rows, host):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join([HEAD, *(
        f"2024-0{1 + i % 3}-10 08:{i % 60:02d}:02,10.0.0.{i % 9},u{i % 5},{host},{i},200" for i in range(rows))]) + "\n")


def seen(spark, root):
    """Rows per table and host or file, as committed."""
    out = {}
    for kind in versions.VERSIONED:
        df = versions.read_committed(spark, root, kind)
        if df is not None:
            label = {"uploads": "filename", "status_rollups": "resp_code", "latency_sketches": "org_id"}.get(kind, "host")
            total = F.sum("requests") if kind.endswith("rollups") else F.sum("line_count") if kind == "uploads" else F.count("*")
            out[kind] = {str(r[0]): r[1] for r in df.groupBy(label).agg(total).collect()}
    return out


@pytest.fixture
def root(spark, tmp_path):
    for name, rows, host in (("a.csv", 30, "old.io"), ("b.csv", 20, "stays.io"), ("c.csv", 10, "too.io")):
        drop(tmp_path / "in", name, rows, host)
    # One bucket: all three uploads share their folders.
    ingest_files(spark, str(tmp_path / "in"), str(tmp_path / "root"), "o1", "own", NOW, "r1", buckets=1)
    return str(tmp_path / "root")


BEFORE = {"old.io": 30, "stays.io": 20, "too.io": 10}
AFTER = {"new.io": 7, "stays.io": 20, "too.io": 10}


def test_a_reader_sees_old_or_new_rows_between_any_two_writes(spark, tmp_path, root, monkeypatch):
    assert seen(spark, root)["entries"] == BEFORE
    views, plain = [], {n: getattr(versions, n) for n in ("write_version", "_copy", "_commit", "_drop_folders")}

    def watched(name):
        def call(*args, **kwargs):
            out = plain[name](*args, **kwargs)
            views.append((name, seen(spark, root)))
            return out
        return call
    for name in plain:
        monkeypatch.setattr(versions, name, watched(name))
    drop(tmp_path / "in", "a.csv", 7, "new.io")
    ingest_files(spark, str(tmp_path / "in" / "a.csv"), root, "o1", "own", NOW, "r2", buckets=1)
    at = [n for n, _ in views].index("_commit")
    assert len(views) == 12 and {n for n, _ in views[:at]} == {"write_version", "_copy"}
    for i, (_, view) in enumerate(views):
        want = BEFORE if i < at else AFTER
        assert view["entries"] == want
        assert {h: n for h, n in view["entry_rollups"].items()} == {h: 2 * n for h, n in want.items()}
        assert view["status_rollups"] == {"200": sum(want.values())}
        assert view["uploads"] == {"a.csv": (31 if i < at else 8), "b.csv": 21, "c.csv": 11}
    # Nothing of the replaced version is left on disk.
    assert spark.read.parquet(f"{root}/entries").count() == 37 and spark.read.parquet(f"{root}/uploads").count() == 3


@pytest.mark.parametrize("dies_in", ["write_version", "_copy", "_commit", "_drop_folders"])
def test_a_crash_loses_nothing_and_a_repeat_heals_it(spark, tmp_path, root, monkeypatch, dies_in):
    plain, calls = getattr(versions, dies_in), []

    def dying(*args, **kwargs):
        calls.append(1)
        if len(calls) == (2 if dies_in in ("write_version", "_copy") else 1):
            raise RuntimeError("lost")
        return plain(*args, **kwargs)
    monkeypatch.setattr(versions, dies_in, dying)
    drop(tmp_path / "in", "a.csv", 7, "new.io")
    one = str(tmp_path / "in" / "a.csv")
    with pytest.raises(RuntimeError):
        ingest_files(spark, one, root, "o1", "own", NOW, "r2", buckets=1)
    assert seen(spark, root)["entries"] == (AFTER if dies_in == "_drop_folders" else BEFORE)
    monkeypatch.setattr(versions, dies_in, plain)
    ingest_files(spark, one, root, "o1", "own", NOW, "r2", buckets=1)
    assert seen(spark, root)["entries"] == AFTER
    versions.sweep(spark, root)
    assert seen(spark, root)["entries"] == AFTER and spark.read.parquet(f"{root}/entries").count() == 37
    assert versions.sweep(spark, root) == []


def test_of_two_writers_from_one_state_a_single_one_commits(spark, root):
    rows, base = versions.pointer(spark, root), versions._newest(spark, root)
    versions._commit(spark, root, rows.where("version != ''"), base)
    with pytest.raises(RuntimeError, match="another job"):
        versions._commit(spark, root, rows.limit(0), base)
    assert versions.pointer(spark, root).count() == 3 and seen(spark, root)["entries"] == BEFORE


def test_erasure_and_rescoring_read_only_named_folders(spark, tmp_path, root):
    drop(tmp_path / "more", "d.csv", 5, "later.io")
    ingest_files(spark, str(tmp_path / "more"), root, "o1", "own", NOW, "r3", buckets=1)
    mine = versions.read_committed(spark, root, "uploads").where("filename = 'd.csv'").select(F.col("id").alias("upload_id"))
    plan = versions.read_committed(spark, root, "entries", mine)._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "version" in filters and "bucket" in filters
    rescore(spark, root, mine, 1)
    tables.erase_uploads(spark, root, mine, "o1")
    assert seen(spark, root)["entries"] == BEFORE
    assert spark.read.parquet(f"{root}/entries").count() == 60


def test_an_upload_without_rows_is_listed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "h.csv").write_text(HEAD + "\n")
    root = str(tmp_path / "root")
    ingest_files(spark, str(tmp_path / "in"), root, "o1", "own", NOW, "r1", buckets=2)
    assert seen(spark, root)["uploads"] == {"h.csv": 1}
    assert versions.read_committed(spark, root, "grants") is None
    assert versions.pointer(spark, str(tmp_path / "none")) is None
