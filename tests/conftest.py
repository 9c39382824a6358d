import os
import sys
from datetime import datetime, timedelta

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"
BASE = datetime(2024, 3, 14, 9, 0, 0)


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


ENTRY = (
    "id long, upload_id string, org_id string, user_id string, line_no int, ts timestamp, client_ip string, "
    "username string, host string, url string, category string, action string, req_bytes long, resp_bytes long, "
    "user_agent string, threat_name string, raw string, resp_code int, method string, latency_ms int, "
    "cache_status string, reason string"
)
_NAMES = [f.split()[0] for f in ENTRY.split(", ")]


def entry(i, seconds=0, **fields):
    row = dict.fromkeys(_NAMES)
    row.update(id=i, upload_id="u1", org_id="o1", user_id="owner", line_no=i + 2, ts=BASE + timedelta(seconds=seconds),
               client_ip="10.0.0.1", username="ann", host="example.com", raw=f"line {i}")
    row.update(fields)
    return tuple(row[n] for n in _NAMES)


def entries(spark, rows):
    return spark.createDataFrame(rows, ENTRY)


def background(start=0):
    """Ordinary traffic: 40 addresses, 15 users, 25 hosts over 90 minutes."""
    return [
        entry(start + i, seconds=i * 9 + (i * 37) % 7, client_ip=f"10.0.1.{i * 7 % 40}", username=f"user{i * 11 % 15}",
              host=f"site{i * 13 % 25}.com", url=f"https://site{i * 13 % 25}.com/", req_bytes=200 + (i * 97) % 1800,
              resp_code=200, latency_ms=10 + i % 90)
        for i in range(600)
    ]
