import ipaddress
from datetime import datetime

import pytest
from conftest import entries, entry
from pyspark.sql import functions as F

from proxyspark.functions import net, text
from proxyspark.operators import rollups
from proxyspark.plans.ingest import ingest_files, reparse
from proxyspark.sources import formats, logs, tables

NOW = datetime(2024, 6, 1)
HEADER = (
    "datetime,recordid,login,department,location,ClientIP,clientpublicIP,serverip,requestmethod,requestsize,"
    "responsesize,transactionsize,url,refererURL,host,urlcategory,urlsupercategory,urlclass,action,reason,respcode,"
    "useragent,threatname"
)
ROW = (
    "2024-03-14 08:00:02,1111,m.chen,Finance,HQ,10.12.7.88,198.51.100.112,93.184.170.182,get,881,15705,16586,"
    "https://stackoverflow.com/api,,stackoverflow.com,Professional Services,IT,Business,Allowed,Allowed,200,"
    '"Mozilla/5.0 (Windows NT 10.0, Win64) ""x"" Chrome/131",None'
)


def parse(spark, tmp_path, content, name="a.log"):
    folder = tmp_path / "in"
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(content)
    raw = logs.scan_logs(spark, str(folder))
    headers = logs.detect_format(logs.file_headers(raw))
    return logs.normalize_logs(logs.number_lines(raw), headers, NOW).orderBy("line_no").collect(), headers.collect()


def test_full_header(spark, tmp_path):
    rows, headers = parse(spark, tmp_path, f"{HEADER}\n{ROW}\n")
    e = rows[0]
    assert len(rows) == 1 and headers[0]["format"] == "nss_web"
    assert (e["client_ip"], e["username"], e["host"], e["method"]) == ("10.12.7.88", "m.chen", "stackoverflow.com", "GET")
    assert (e["resp_code"], e["req_bytes"], e["resp_bytes"], e["line_no"]) == (200, 881, 15705, 2)
    assert e["user_agent"] == 'Mozilla/5.0 (Windows NT 10.0, Win64) "x" Chrome/131'
    assert e["threat_name"] is None and e["raw"] == ROW
    assert e["ts"] == datetime(2024, 3, 14, 8, 0, 2)


def test_bad_line_is_kept_raw(spark, tmp_path):
    rows, _ = parse(spark, tmp_path, "datetime,ClientIP,url\nnot-a-date,not-an-ip,\n")
    assert len(rows) == 1 and rows[0]["ts"] is None and rows[0]["client_ip"] is None
    assert rows[0]["raw"] == "not-a-date,not-an-ip,"


@pytest.mark.parametrize("sep", ["\t", "|", ","])
def test_delimiters_and_column_order(spark, tmp_path, sep):
    body = sep.join(["url", "ClientIP", "datetime"]) + "\n" + sep.join(["http://x.io/a", "10.0.0.1", "2024-03-14 08:00:02"])
    rows, _ = parse(spark, tmp_path, body)
    assert (rows[0]["client_ip"], rows[0]["host"], rows[0]["url"]) == ("10.0.0.1", "x.io", "http://x.io/a")


def test_short_rows_markers_and_blank_lines(spark, tmp_path):
    rows, _ = parse(spark, tmp_path,
                    "datetime,ClientIP,login,respcode\n2024-03-14 08:00:02,10.0.0.1\n\n2024-03-14 08:00:03,10.0.0.2,-,N/A\n")
    assert [r["line_no"] for r in rows] == [2, 3]
    assert rows[0]["resp_code"] is None and rows[1]["username"] is None and rows[1]["resp_code"] is None


def test_header_only_empty_and_foreign_files(spark, tmp_path):
    assert parse(spark, tmp_path, HEADER + "\n", "h.csv")[0] == []
    (tmp_path / "in" / "e.csv").write_text("")
    (tmp_path / "in" / "f.txt").write_text("alpha,beta,gamma\n1,2,3\n")
    (tmp_path / "in" / "s.log").write_text("Mar 14 08:00:02 host sshd[1]: accepted\n")
    (tmp_path / "in" / "skip.json").write_text("datetime,ClientIP\n1,2\n")
    headers = logs.detect_format(logs.file_headers(logs.scan_logs(spark, str(tmp_path / "in"))))
    by_name = {r["file"].split("/")[-1]: r["format"] for r in headers.collect()}
    assert by_name == {"h.csv": "nss_web", "f.txt": None, "s.log": None}
    assert logs.rejected_files(headers).count() == 2


def test_line_numbers_across_splits(spark, tmp_path):
    folder = tmp_path / "big"
    folder.mkdir()
    lines = [f"2024-03-14 08:00:02,10.0.{i % 200}.{i % 99},u{i}" for i in range(20_000)]
    (folder / "big.csv").write_text("datetime,ClientIP,login\n" + "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    spark.conf.set("spark.sql.files.openCostInBytes", "1024")
    try:
        raw = logs.scan_logs(spark, str(folder))
        tables.archive_raw(raw, str(tmp_path / "arch"))
        stored = spark.read.parquet(str(tmp_path / "arch"))
        assert stored.select("split_start").distinct().count() > 4
        got = reparse(spark, str(tmp_path / "arch"), NOW).select("line_no", "username").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(got) == 20_000 and all(r["username"] == f"u{r['line_no'] - 2}" for r in got)


def one(spark, column, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(column(F.col("v"))).collect()]


def test_timestamps(spark):
    same = ["2024-03-14 08:00:02", "2024-03-14T08:00:02", "2024-03-14T08:00:02Z", "2024/03/14 08:00:02",
            "14/Mar/2024:08:00:02 +0000", "1710403202", "1710403202000", "2024-03-14T10:00:02+02:00", "Mar 14 08:00:02",
            "2024-03-14 8:00:02"]
    assert set(one(spark, lambda c: text.parse_ts(c, NOW), same)) == {datetime(2024, 3, 14, 8, 0, 2)}
    assert one(spark, lambda c: text.parse_ts(c, NOW), ["Mar  4 08:00:02", "2024-03-14 08:00:02.5"]) == [
        datetime(2024, 3, 4, 8, 0, 2), datetime(2024, 3, 14, 8, 0, 2, 500000)]
    assert set(one(spark, lambda c: text.parse_ts(c, NOW), ["2024-03-14", "soon", "2024-13-14 08:00:02", None])) == {None}


def test_numbers(spark):
    assert one(spark, text.parse_long, ["12.9", "-3", "1e3", "12d", "", None, ".5"]) == [12, 0, 1000, None, None, None, 0]


def test_clean_and_host(spark):
    assert one(spark, text.clean_value, [' "a" ', "-", "None", "NA", "N/A", "na", "\t-\t", ""]) == ["a", None, None, None, None, "na", None, None]
    assert one(spark, text.host_from_url, ["https://files.example.com:8443/a/b", "x.io/p", "", None]) == ["files.example.com", "x.io", None, None]
    assert one(spark, text.normalize_name, [" Client IP_1 "]) == ["clientip1"]


def test_addresses(spark):
    good = ["10.0.0.1", "2001:db8::1", "::", "::1", "2001:0DB8:0:0:1:0:0:1", "fe80:0:0:0:0:0:0:1", "1:0:0:2:0:0:0:3", "1:2:3:4:5:6:7:8"]
    assert one(spark, net.parse_ip, good) == [str(ipaddress.ip_address(g)) for g in good]
    assert one(spark, net.parse_ip, ["::ffff:1.2.3.4", "::ffff:0102:0304"]) == ["::ffff:1.2.3.4"] * 2
    assert one(spark, net.parse_ip, ["256.1.1.1", "01.2.3.4", "1.2.3", "1::2::3", "1:2:3", "g::1", "12345::", "x", None]) == [None] * 9


def test_subnets(spark):
    ips = ["10.12.2.1", "10.12.3.255", "10.12.4.0", "2001:db8::5", "2001:db9::5", None]
    assert one(spark, lambda c: net.ip_in_cidr(c, "10.12.2.0/23"), ips) == [True, True, False, False, False, False]
    assert one(spark, lambda c: net.ip_in_cidr(c, "2001:db8::/32"), ips) == [False, False, False, True, False, False]


def test_registry_of_formats(spark):
    own = formats.LogFormat("squid_like", {"ts": ["zeit"], "client_ip": ["quelle"]})
    headers = spark.createDataFrame([("f", "Zeit|Quelle")], "file string, header string")
    row = logs.detect_format(headers, [own]).collect()[0]
    assert row["format"] == "squid_like" and row["delimiter"] == "|" and row["cols"]["client_ip"] == 1
    with pytest.raises(ValueError):
        formats.register(formats.LogFormat("nss_web"))


def test_job_is_complete_repeatable_and_erasable(spark, tmp_path):
    folder, root = tmp_path / "src", str(tmp_path / "root")
    folder.mkdir()
    head = "datetime,ClientIP,login,host,requestsize,responsesize,respcode,totaltime,tcpstatus"
    for name in ("one.csv", "two.csv"):
        body = [f"2024-03-{10 + i % 3} 08:{i % 60:02d}:02,10.0.0.{i % 9},u{i % 5},h{i % 4}.io,{i},{i * 2},{404 if i % 10 == 0 else 200},"
                f"{i % 50},{'TCP_HIT' if i % 4 == 0 else 'TCP_MISS'}" for i in range(200)] + ["broken line"]
        (folder / name).write_text("\n".join([head, *body]) + "\n")
    (folder / "odd.txt").write_text("alpha,beta\n1,2\n")

    def counts():
        read = lambda t: spark.read.parquet(f"{root}/{t}")
        return {t: read(t).count() for t in ("entries", "entry_rollups", "status_rollups", "uploads")}

    rejected = ingest_files(spark, str(folder), root, "o1", "owner", NOW, "r1", buckets=4)
    assert [r["file"].split("/")[-1] for r in rejected.collect()] == ["odd.txt"]
    first = counts()
    assert first["entries"] == 402 and first["uploads"] == 2
    manifest = spark.read.parquet(f"{root}/uploads").collect()
    assert {(r["line_count"], r["parsed_count"]) for r in manifest} == {(202, 200)}
    assert all(r["object_key"] == f"o1/owner/2024/06/01/{r['id']}" for r in manifest)
    ingest_files(spark, str(folder), root, "o1", "owner", NOW, "r2", buckets=4)
    assert counts() == first

    stored = spark.read.parquet(f"{root}/entries")
    for grain in ("minute", "hour"):
        direct = stored.where("ts IS NOT NULL").groupBy("upload_id", "host", F.date_trunc(grain, "ts").alias("bucket_start")).agg(
            F.count("*").alias("requests"), F.sum("req_bytes").alias("bytes_out"), F.count_if(F.col("resp_code") >= 400).alias("errors"),
            F.expr("CAST(percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms) AS INT)").alias("latency_p95"))
        kept = spark.read.parquet(f"{root}/entry_rollups").where(F.col("grain") == grain).select(direct.columns)
        assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, direct.collect()))
    assert tables.committed(stored, spark.read.parquet(f"{root}/uploads")).count() == 402

    victim = manifest[0]["id"]
    ids = spark.createDataFrame([(victim,)], "upload_id string")
    foreign = {r[0]: r[1] for r in tables.erase_uploads(spark, root, ids, "other").collect()}
    assert set(foreign.values()) == {0} and counts() == first
    erased_counts = tables.erase_uploads(spark, root, ids, "o1")
    erased = {r[0]: r[1] for r in erased_counts.collect()}
    assert erased["entries"] == 201 and erased["uploads"] == 1
    # Two runs hold the file: header and 201 lines each.
    assert (erased["archive"], erased["archive_files"]) == (404, 2)
    assert not spark.read.parquet(f"{root}/archive_files").where(F.col("upload_id") == victim).count()
    after = counts()
    assert after["entries"] == 201 and after["uploads"] == 1
    audit = tables.erase_audit(erased_counts, "admin", "o1", victim, NOW).collect()[0]
    assert audit["action"] == "upload.deleted" and '"entries":201' in audit["detail"]
    rest = spark.createDataFrame([(manifest[1]["id"],)], "upload_id string")
    tables.erase_uploads(spark, root, rest, "o1")
    assert not list((tmp_path / "root" / "entries").glob("month=*/bucket=*/*.parquet"))


def test_erasure_reaches_runs_and_keeps_the_names_of_folders(spark, tmp_path):
    root, folder = str(tmp_path / "root"), tmp_path / "in"
    folder.mkdir()
    for name in ("a.csv", "b.csv"):
        (folder / name).write_text("datetime,ClientIP,login,host\n2024-06-01 08:00:00,10.0.0.1,u,h.io\n")
    ingest_files(spark, str(folder), root, "o1", "owner", NOW, "007", buckets=2)
    first, second = sorted(r["id"] for r in spark.read.parquet(f"{root}/uploads").collect())
    runs = spark.createDataFrame([("r1", first), ("r2", second)], "id string, upload_id string")
    tables.write_table(runs, f"{root}/analyses", "analyses", 2)
    per_run = runs.select(F.col("id").alias("analysis_id"))
    tables.save_findings(per_run, f"{root}/findings", 2)
    tables.save_vectors(per_run, f"{root}/vectors", 2)
    tables.append_timings(per_run, f"{root}/timings")
    tables.append_status(per_run, f"{root}/status")
    erased = {r[0]: r[1] for r in tables.erase_uploads(
        spark, root, spark.createDataFrame([(first,)], "upload_id string"), "o1").collect()}
    assert {erased[k] for k in ("entries", "analyses", "findings", "vectors", "timings", "status", "archive_files")} == {1}
    assert erased["archive"] == 2 and erased["grants"] == 0
    assert [r["analysis_id"] for r in spark.read.parquet(f"{root}/findings").collect()] == ["r2"]
    assert [f.name for f in (tmp_path / "root" / "archive").glob("run=*")] == ["run=007"]
    assert spark.read.parquet(f"{root}/archive").count() == 2


def test_replacing_findings_leaves_other_runs(spark, tmp_path):
    path = str(tmp_path / "f")
    rows = spark.createDataFrame([("a", "x", 1), ("b", "x", 2)], "analysis_id string, kind string, n int")
    tables.save_findings(rows, path, 4)
    tables.save_findings(spark.createDataFrame([("a", "y", 3)], rows.schema), path, 4)
    assert sorted((r["analysis_id"], r["n"]) for r in spark.read.parquet(path).collect()) == [("a", 3), ("b", 2)]


def test_null_times_are_kept_but_in_no_bucket(spark):
    df = entries(spark, [entry(1), entry(2, ts=None), entry(3, ts=None, client_ip=None)])
    assert rollups.entry_rollups(df, "hour").groupBy().sum("requests").collect()[0][0] == 1
    with pytest.raises(ValueError):
        rollups.entry_rollups(df, "day")


def test_status_changes(spark):
    events = spark.createDataFrame(
        [("a", 1, "queued"), ("a", 2, "running"), ("a", 3, "done"), ("a", 4, "running"), ("b", 1, "running")],
        "analysis_id string, event_ts long, status string")
    kept = sorted((r[0], r[1]) for r in tables.valid_status_changes(events).collect())
    assert kept == [("a", 1), ("a", 2), ("a", 3), ("b", 1)]
