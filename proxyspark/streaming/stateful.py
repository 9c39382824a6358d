"""Stateful streams: alert transitions, heartbeat timeouts, login throttling.

Alerts and heartbeats are judged in event time: a key's rows wait in list state until
the watermark has passed them, and a timer releases them in order, so the outcome does
not depend on which micro-batch brought a row. What waits is bounded by the watermark's
delay. Sign-ins are put in time order per micro-batch; bound it with the source's
per-trigger limits.
"""

import sys

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from proxyspark import fixed

# The processors below travel to the Python workers by value, so a worker needs
# no copy of this package. They take their settings as arguments for that.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _micros(value) -> int:
    return int(pd.Timestamp(value).value // 1000)


def _stamp(micros: int):
    return pd.Timestamp(micros, unit="us")


def _all_micros(times: pd.Series) -> pd.Series:
    return times.astype("datetime64[ns]").astype("int64") // 1000


def _packed(frame: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(frame, preserve_index=False).replace_schema_metadata()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(block: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(block).read_pandas()


def _in_order(rows, column: str) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values([column], kind="stable")


def keep_state_on_disk(df: DataFrame) -> DataFrame:
    """State of these streams lives in RocksDB, so it may outgrow memory."""
    df.sparkSession.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return df


def _reset_timer(handle, at_millis: int | None = None) -> None:
    """One timer per key: drop any earlier one, then set the new one."""
    for timer in list(handle.listTimers()):
        handle.deleteTimer(timer[0] if isinstance(timer, (tuple, list)) else timer)
    if at_millis is not None:
        handle.registerTimer(at_millis)


class _InOrder(StatefulProcessor):
    """Holds rows (at, and whatever a subclass reads) until the watermark passed them.

    ``columns_of`` names the held columns of a batch, ``at`` in microseconds first;
    ``steps`` takes all due rows in order and gives output rows; ``idle`` is called when
    they are done and may ask for a later look, in microseconds. Rows are held as one
    Arrow block per batch and state is read and written once per call: going to the
    state store for every row costs more than all else.
    """

    columns: list

    def init(self, handle):
        self.handle = handle
        self.held = handle.getListState("held", "block binary")
        self.open_state(handle)

    def handleInputRows(self, key, rows, timerValues):
        first = None
        for frame in rows:
            batch = self.columns_of(frame)
            self.held.appendValue((_packed(batch),))
            first = min([int(batch["at"].min())] + ([first] if first is not None else []))
        # A timer stands for the first row that waits; an earlier row moves it up.
        known = [t[0] if isinstance(t, (tuple, list)) else t for t in self.handle.listTimers()]
        due = _due_millis(first)
        if not known or due < min(known):
            _reset_timer(self.handle, due)
        yield pd.DataFrame([], columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs() * 1000
        blocks = [_unpacked(r[0]) for r in self.held.get()] if self.held.exists() else []
        rows = pd.concat(blocks) if blocks else pd.DataFrame({"at": pd.Series([], dtype="int64")})
        late = rows["at"] > now
        due, later = rows[~late], rows[late]
        if len(later):
            self.held.put([(_packed(later),)])
        else:
            self.held.clear()
        out = self.steps(key, due.sort_values(list(due.columns))) if len(due) else []
        more, look = self.idle(key, now)
        waits = [_due_millis(int(later["at"].min()))] if len(later) else []
        _reset_timer(self.handle, min(waits + ([look // 1000] if look is not None else []), default=None))
        yield pd.DataFrame(out + more, columns=self.columns)

    def close(self):
        pass


def _due_millis(at: int) -> int:
    """Timers fire once the watermark is beyond them: this one when it reaches ``at``."""
    return -(-at // 1000) - 1


class _AlertState(_InOrder):
    columns = ["window_start", "alert", "state", "value"]

    def open_state(self, handle):
        self.firing = handle.getValueState("firing", "firing boolean")

    def columns_of(self, frame):
        return pd.DataFrame({"at": _all_micros(frame["window_start"]), "breached": frame["breached"].astype(bool), "value": frame["value"].astype(float)})

    def steps(self, key, due):
        before = firing = bool(self.firing.get()[0]) if self.firing.exists() else False
        out = []
        for at, breached, value in zip(due["at"].tolist(), due["breached"].tolist(), due["value"].tolist()):
            if breached != firing:
                firing = breached
                out.append((_stamp(at), key[0], "firing" if breached else "resolved", value))
        if firing != before:
            self.firing.update((firing,))
        return out

    def idle(self, key, now):
        return [], None


def alert_transitions(checks: DataFrame, watermark: str = "0 seconds") -> DataFrame:
    """Firing and resolved changes from a stream of threshold checks
    (window_start, alert, value, breached), in the order of their windows.

    A check is judged once the watermark has reached its window: checks may come up to
    ``watermark`` later than the newest one, in any order and any micro-batch.
    """
    return keep_state_on_disk(checks).select("window_start", "alert", "value", "breached").withWatermark(
        "window_start", watermark).groupBy("alert").transformWithStateInPandas(
        statefulProcessor=_AlertState(),
        outputStructType="window_start timestamp, alert string, state string, value double",
        outputMode="Append", timeMode="EventTime")


class _Heartbeat(_InOrder):
    columns = ["analysis_id", "last_seen", "status"]

    def __init__(self, seconds: int):
        self.silence = seconds * 1_000_000

    def open_state(self, handle):
        self.last = handle.getValueState("last", "at long")

    def columns_of(self, frame):
        return pd.DataFrame({"at": _all_micros(frame["ts"]), "running": frame["status"] == "running"})

    def steps(self, key, due):
        """Rows of one instant: those that are not running come first."""
        last = self.last.get()[0] if self.last.exists() else None
        at, running = due["at"].to_numpy(), due["running"].to_numpy()
        seen, then = at[:-1][running[:-1]], at[1:][running[:-1]]
        gone = seen[then - seen > self.silence].tolist()
        if last is not None and at[0] - last > self.silence:
            gone.insert(0, last)
        if running[-1]:
            self.last.update((int(at[-1]),))
        elif last is not None:
            self.last.clear()
        return [(key[0], _stamp(x), "queued") for x in gone]

    def idle(self, key, now):
        """Nothing waits that is due: has the run been silent for too long by now?"""
        if not self.last.exists():
            return [], None
        last = self.last.get()[0]
        if now - last <= self.silence:
            return [], last + self.silence
        self.last.clear()
        return [(key[0], _stamp(last), "queued")], None


def heartbeat_timeouts(beats: DataFrame, seconds: int = fixed.STALE_SECONDS, watermark: str = "1 minute") -> DataFrame:
    """Runs to queue again: running, and silent for longer than ``seconds`` of
    event time. ``beats`` has analysis_id, ts, status; they may come up to
    ``watermark`` late, in any order and any micro-batch."""
    return keep_state_on_disk(beats).select("analysis_id", "ts", "status").withWatermark("ts", watermark).groupBy(
        "analysis_id").transformWithStateInPandas(
        statefulProcessor=_Heartbeat(seconds),
        outputStructType="analysis_id string, last_seen timestamp, status string",
        outputMode="Append", timeMode="EventTime")


class _Throttle(StatefulProcessor):
    """Failures in a window that starts at the first one and does not move.

    ``rules`` maps a dimension to (failures allowed, window seconds).
    """

    def __init__(self, rules: dict, lock_seconds: int):
        self.rules, self.lock = rules, lock_seconds * 1_000_000

    def init(self, handle):
        self.handle = handle
        self.state = handle.getValueState("window", "anchor long, failures long, locked_until long")

    def handleInputRows(self, key, rows, timerValues):
        by_account = key[0] == "account"
        limit, window = self.rules[key[0]]
        window *= 1_000_000
        anchor, failures, locked = self.state.get() if self.state.exists() else (0, 0, 0)
        frame = _in_order(rows, "at")
        out = []
        for event, at, success in zip(frame["id"], frame["at"], frame["success"]):
            if failures and at >= anchor + window:
                failures = 0
            blocked = at < locked if by_account else failures >= limit
            # An attempt that is turned away is neither counted nor believed.
            if success and by_account and not blocked:
                failures = locked = 0
            elif not success and not blocked:
                anchor = at if failures == 0 else anchor
                failures += 1
                if by_account and failures >= limit:
                    locked = at + self.lock
            out.append((event, key[0], key[1], at, failures, blocked))
        self.state.update((anchor, failures, locked))
        # Nothing recorded now matters once both the window and a lock ended.
        _reset_timer(self.handle, (max(anchor + window, locked)) // 1000 + 1)
        yield pd.DataFrame(out, columns=["id", "dimension", "key", "at", "failures", "blocked"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.state.clear()
        yield pd.DataFrame([], columns=["id", "dimension", "key", "at", "failures", "blocked"])

    def close(self):
        pass


def account_key(account):
    """Handle of an account name, so the output is no list of users."""
    return F.left(F.sha2(F.lower(F.trim(account)), 256), F.lit(16))


def login_throttle(auth: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Per sign-in attempt and dimension (ip, account): failures so far and
    whether it fell under a throttle or lock. ``auth`` has id, ts, ip, account,
    success. A success clears its account, never the address; an attempt that
    a dimension turns away leaves that dimension as it was, so a lock ends on
    time under attack. Each dimension is judged on its own: what the other one
    would have turned away still counts here."""
    rules = {
        "ip": (fixed.IP_FAILURES, fixed.IP_WINDOW_SECONDS),
        "account": (fixed.ACCOUNT_FAILURES, fixed.ACCOUNT_WINDOW_SECONDS),
    }
    sides = F.explode(F.array(
        F.struct(F.lit("ip").alias("dimension"), F.col("ip").alias("key")),
        F.struct(F.lit("account").alias("dimension"), account_key(F.col("account")).alias("key")))).alias("d")
    keyed = keep_state_on_disk(auth).withWatermark("ts", watermark).select(
        "id", "ts", F.unix_micros("ts").alias("at"), "success", sides).select(
        "id", "ts", "at", "success", "d.dimension", "d.key")
    decided = keyed.groupBy("dimension", "key").transformWithStateInPandas(
        statefulProcessor=_Throttle(rules, fixed.LOCK_SECONDS),
        outputStructType="id long, dimension string, key string, at long, failures long, blocked boolean",
        outputMode="Append", timeMode="EventTime")
    return decided.withColumn("ts", F.timestamp_micros("at")).drop("at")
