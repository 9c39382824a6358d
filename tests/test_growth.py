"""Steps whose cost or memory must not grow with what one key, run or text holds."""

from datetime import timedelta

import pytest
from conftest import BASE
from pyspark.sql import functions as F

from proxyspark.operators import findings, history, search
from proxyspark.session import JOINED_BYTES, PARTITIONS, SPLIT_BYTES, pin
from proxyspark.sources import tables
from proxyspark.streaming import stateful

_RUNS = "id string, org_id string, upload_id string, created_at timestamp, baseline_window_days int"
_HOURS = "org_id string, upload_id string, host string, grain string, bucket_start timestamp, requests long, errors long"


def test_runs_that_ask_the_same_are_one_question(spark):
    at = BASE.replace(minute=0, second=0)
    hours = spark.createDataFrame(
        [("o", f"u{k % 3}", f"h{k % 5}", "hour", at - timedelta(hours=k), k * 37 % 200, k % 3) for k in range(200)], _HOURS)
    # Starts within one hour, of 300 runs of two uploads and one that is unknown.
    runs = spark.createDataFrame(
        [(f"r{k}", "o", [None, "u0", "u1"][k % 3], at + timedelta(seconds=7 * k + 1), 3 if k % 2 else None) for k in range(300)], _RUNS)
    written = {}

    def write(df, name):
        written[name] = df.count()
        return df
    got = history.history_baselines(hours, runs, write).collect()
    assert len(got) == 150 and max(written.values()) <= 3
    rows = hours.collect()
    for own, mine in ((None, 3), ("u0", 1), ("u1", 5)):
        kept = [r for r in rows if r["upload_id"] != own and r["bucket_start"] > at - timedelta(days=3)]
        counts = sorted(r["requests"] for r in kept)
        want = (3, sum(counts), sum(r["errors"] for r in kept), len({r["host"] for r in kept}), float(counts[(len(counts) + 1) // 2 - 1]))
        assert {tuple(r)[1:] for r in got if r["run_id"] in {f"r{k}" for k in range(mine, 300, 6)}} == {want}


def test_index_copies_no_text_into_word_rows(spark):
    df = spark.createDataFrame([(1, "The hosts, hosts and files!", "k"), (2, None, "a b"), (2, "", None)], "id long, explanation string, kind string")
    index = search.build_finding_index(df)
    got = sorted(tuple(r) for r in index.select("finding_id", "form", "field", "pos", "token", "weight").collect())
    split = [(1, "split", "explanation", i, w, 0.1) for i, w in enumerate("the hosts hosts and files".split())]
    split += [(1, "split", "kind", 0, "k", 0.1), (2, "split", "kind", 0, "a", 0.1), (2, "split", "kind", 1, "b", 0.1)]
    stems = [(1, "stemmed", "explanation", i, w, 0.4) for i, w in ((1, "host"), (2, "host"), (4, "file"))]
    stems += [(1, "stemmed", "kind", 0, "k", 1.0), (2, "stemmed", "kind", 1, "b", 1.0)]
    assert got == sorted(split + stems)
    plan = index._jdf.queryExecution().optimizedPlan().toString()
    # One pass over the texts, and words exploded from a column of their own.
    assert plan.count("posexplode(words") == 1 and "size(" not in plan and plan.count("split(") == 1


def test_latest_status_deals_texts_over_fixed_parts(spark):
    at = lambda m: BASE + timedelta(minutes=m)
    rows = [("a", at(0), "queued", None), ("a", at(1), "running", None), ("a", at(2), "failed", "e" * 5000), ("a", at(3), "running", None),
            ("b", at(0), "running", "x"), ("b", at(5), "queued", "y"), ("c", None, "done", "z"), (None, at(1), "done", None),
            ("d", at(1), "failed", "old"), ("d", at(2), "running", None), ("d", at(9), "done", None)]
    out = findings.latest_status(spark.createDataFrame(rows, "analysis_id string, event_ts timestamp, status string, error string"))
    got = {r["analysis_id"]: tuple(r)[1:] for r in out.collect()}
    assert got == {"a": ("failed", at(2), "e" * 2000, at(1), at(2)), "b": ("queued", at(5), "y", at(0), None),
                   "c": (None, None, None, None, None), "d": ("done", at(9), None, None, at(9))}
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "REPARTITION_BY_NUM" in plan and plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_shuffles_and_splits_do_not_follow_the_cores(spark):
    pin(spark)
    assert spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum") == str(PARTITIONS)
    assert spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes() <= SPLIT_BYTES


def test_adaptive_execution_joins_small_parts_only(spark):
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    usual = spark.conf.get(name)
    try:
        for given, kept in (("64MB", str(JOINED_BYTES)), ("1g", str(JOINED_BYTES)), ("2m", "2m")):
            spark.conf.set(name, given)
            pin(spark)
            assert spark.conf.get(name) == kept
        spark.conf.set(name, "64MB")
        pin(spark)
        # 96 MB that do not compress, for four cores: 24 MB each, if parts are joined as given.
        dealt = spark.range(6_000_000).select(F.xxhash64("id").alias("a"), F.xxhash64(-F.col("id")).alias("b")).repartition("a")
        sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 6_000_000 and max(sizes) < 1_000_000
    finally:
        spark.conf.set(name, usual)


def test_erasure_looks_its_keys_up_once(spark, tmp_path, monkeypatch):
    root, names = str(tmp_path), {}
    uploads = spark.createDataFrame([("u1", "o1", BASE), ("u2", "o1", BASE), ("u3", "o2", BASE)], "id string, org_id string, created_at timestamp")
    runs = spark.createDataFrame([("a1", "u1"), ("a2", "u2"), ("a3", "u3"), (None, "u1")], "id string, upload_id string")
    found = spark.createDataFrame([(k, f"a{k % 3 + 1}") for k in range(9)] + [(9, "u1"), (10, None)], "id long, analysis_id string")
    for kind, df in (("uploads", uploads), ("analyses", runs), ("findings", found)):
        tables.write_table(df, f"{root}/{kind}", kind, 2)
    plain = tables.delete_keys

    def watched(spark, path, kind, keys, *more, **named):
        names[kind] = keys._jdf.queryExecution().withCachedData().toString()
        return plain(spark, path, kind, keys, *more, **named)
    monkeypatch.setattr(tables, "delete_keys", watched)
    asked = spark.createDataFrame([("u1",), ("u1",), ("u3",), (None,)], "upload_id string")
    got = {r["table_name"]: r["erased"] for r in tables.erase_uploads(spark, root, asked, "o1").collect()}
    assert {k: n for k, n in got.items() if n} == {"findings": 4, "analyses": 2, "uploads": 1}
    assert sorted(r["id"] for r in spark.read.parquet(f"{root}/findings").collect()) == [1, 2, 4, 5, 7, 8, 10]
    assert all("InMemoryRelation" in plan for plan in names.values()), names


class _State:
    """A state variable that counts the calls that would go to the state store."""

    def __init__(self):
        self.value, self.calls = None, 0

    def exists(self):
        self.calls += 1
        return bool(self.value)

    def get(self):
        self.calls += 1
        return iter(self.value) if isinstance(self.value, list) else self.value

    def appendValue(self, value):
        self.calls += 1
        self.value = [*(self.value or []), value]

    def put(self, value):
        self.calls, self.value = self.calls + 1, list(value)

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.calls, self.value = self.calls + 1, None


class _Handle:
    def __init__(self):
        self.states, self.timers = {}, []

    def getListState(self, name, schema):
        return self.states.setdefault(name, _State())

    getValueState = getListState

    def listTimers(self):
        return list(self.timers)

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class _Time:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return int(self.at.timestamp() * 1000)


@pytest.mark.parametrize("n", [10, 3000])
def test_heartbeats_touch_state_per_call_not_per_row(n):
    import pandas as pd

    handle, beat = _Handle(), stateful._Heartbeat(60)
    beat.init(handle)
    # Beats 10 s apart, a gap of 100 s before the last, and one that lies ahead.
    start = pd.Timestamp("2024-01-01")
    times = [start + pd.Timedelta(seconds=10 * k) for k in range(n)]
    end = times[-1] + pd.Timedelta(seconds=100)
    frame = pd.DataFrame({"ts": [*times, end, end + pd.Timedelta(days=1)], "status": ["running"] * n + ["done", "running"]})
    list(beat.handleInputRows(("run",), iter([frame.sample(frac=1, random_state=1)]), None))
    watermark = _Time((end + pd.Timedelta(seconds=1)).tz_localize("UTC"))
    out = pd.concat(list(beat.handleExpiredTimer(("run",), watermark, None)))
    assert [tuple(r) for r in out.itertuples(index=False)] == [("run", times[-1], "queued")]
    assert sum(s.calls for s in handle.states.values()) < 10 and len(handle.timers) == 1


def test_a_beat_without_a_time_is_the_earliest(spark):
    import pandas as pd

    times = pd.Series(pd.to_datetime(["2024-01-01 00:00:00.000001", None]))
    assert stateful._all_micros(times).tolist() == [stateful._micros(t) for t in times]
    packed = pd.DataFrame({"at": stateful._all_micros(times), "running": [True, False]})
    assert stateful._unpacked(stateful._packed(packed)).equals(packed)
