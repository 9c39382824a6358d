"""Throttling across both dimensions against one pass in time order."""

import random
from datetime import datetime, timedelta

from proxyspark.operators.throttle import throttle_attempts

BASE = datetime(2024, 1, 1)
SCHEMA = "id long, ts timestamp, ip string, account string, success boolean"


def in_order(events):
    """(id) -> (decision, address's failures, account's failures), one attempt after the other."""
    out, addresses, accounts = {}, {}, {}
    for i, ts, ip, account, ok in sorted(events, key=lambda e: (e[1], e[0])):
        at = (ts - BASE).total_seconds()
        a = addresses.setdefault(ip, [0, 0.0]) if ip is not None else [0, 0.0]
        b = accounts.setdefault(account.strip().lower(), [0, 0.0, 0.0]) if account is not None else [0, 0.0, 0.0]
        if a[0] and at >= a[1] + 300:
            a[0] = 0
        if b[0] and at >= b[1] + 1800:
            b[0] = 0
        decision = "throttled" if a[0] >= 20 else "locked" if at < b[2] else "allowed"
        if decision == "allowed":
            if ok:
                b[0], b[2] = 0, 0.0
            else:
                a[1] = at if a[0] == 0 else a[1]
                b[1] = at if b[0] == 0 else b[1]
                a[0] += ip is not None
                b[0] += account is not None
                if b[0] >= 10:
                    b[2] = at + 900
        out[i] = (decision, a[0], b[0])
    return out


def judged(spark, events, tmp_path):
    got = throttle_attempts(spark.createDataFrame(events, SCHEMA), str(tmp_path / "rounds"))
    return {r["id"]: (r["decision"], r["ip_failures"], r["account_failures"]) for r in got.collect()}


def test_dense_traffic_where_every_key_meets_every_other(spark, tmp_path):
    rng, at, events = random.Random(5), 0.0, []
    for i in range(4000):
        at += rng.choice([0, 0.3, 1, 2, 4])
        if i % 900 == 899:
            at += rng.choice([299, 300, 1799, 1800, 2000])
        account = f" User{rng.randrange(14)}@x.io" if rng.random() < 0.5 else f"user{rng.randrange(14)}@X.io "
        events.append((i, BASE + timedelta(seconds=at), f"10.0.0.{rng.randrange(5)}", account, rng.random() < 0.1))
    want = in_order(events)
    assert {d for d, _, _ in want.values()} == {"throttled", "locked", "allowed"}
    assert judged(spark, events, tmp_path) == want


def test_hot_address_quiet_accounts_and_nulls(spark, tmp_path):
    events = [(i, BASE + timedelta(seconds=5 * i), "10.0.0.1", f"u{i}", False) for i in range(300)]
    events += [(1000 + i, BASE + timedelta(seconds=40 * i), None, "v", False) for i in range(40)]
    events += [(2000 + i, BASE + timedelta(seconds=3 * i), "10.0.0.2", None, None) for i in range(40)]
    want = in_order([(*e[:4], bool(e[4])) for e in events])
    assert judged(spark, events + [(5000, None, "10.0.0.1", "u1", False)], tmp_path) == want
    assert want[1039][0] in ("locked", "allowed") and any(d == "throttled" for d, _, _ in want.values())


def test_no_attempts(spark, tmp_path):
    assert judged(spark, [], tmp_path) == {}
