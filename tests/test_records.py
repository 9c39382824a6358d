"""Records over line breaks, against a single pass over the whole text."""

import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from proxyspark.plans.ingest import archived_lines, ingest_files, reparse_upload
from proxyspark.sources import logs, records, versions

NOW = datetime(2024, 6, 1)


def plain_records(text, sep=","):
    """(line number, record) as one pass over the characters finds them."""
    out, lines, at = [], text.split("\n"), 0
    if lines and lines[-1] == "":
        lines.pop()

    def after(line, inside):
        i, start = 0, True
        while i < len(line):
            c = line[i]
            if inside:
                if c == '"':
                    if line[i + 1:i + 2] == '"':
                        i += 1
                    elif i + 1 == len(line) or line[i + 1] == sep:
                        inside = False
            elif c == '"' and start:
                inside = True
            start = not inside and c == sep
            i += 1
        return inside
    while at < len(lines):
        if lines[at] == "":
            at += 1
            continue
        end, inside = at, after(lines[at], False)
        while inside and end + 1 < len(lines):
            end += 1
            inside = after(lines[end], True)
        if inside:  # never closed: every line stands alone
            out += [line for line in lines[at:] if line]
            break
        out.append("\n".join(lines[at:end + 1]))
        at = end + 1
    return list(enumerate(out, 1))


def odd_text(seed, n=400, sep=","):
    rng = random.Random(seed)
    cells = ["x", "", "5\" wide", '"a b"', '"say ""hi"""', f'"one{sep}two"', '"two\nlines"', '"gap\n\n\nend"', '"a\n""b""\nc"', "tail\"", '"q" z"', '""', '"\n"']
    rows = [sep.join(rng.choice(cells) for _ in range(3)) for _ in range(n)]
    blanks = [r + ("\n" * rng.choice([0, 0, 0, 1, 3])) for r in rows]
    return f"datetime{sep}ClientIP{sep}login\n" + "\n".join(blanks) + "\n"


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_records_of_many_splits_equal_one_pass(spark, tmp_path, small_splits):
    texts = {f"f{i}.csv": odd_text(i, n) for i, n in enumerate((250, 40, 3, 1))}
    texts |= {"plain.csv": "datetime,ClientIP\n" + "a,b\n" * 600, "open.csv": 'datetime,ClientIP\na,b\nc,"d\n\ne,f\n' + "g,h\n" * 300,
              "blank.csv": "\n\ndatetime,ClientIP\n" + "a,b\n\n\n" * 200, "tabs.tsv": odd_text(9, 60, "\t"), "long.csv": "datetime,ClientIP\na,\"" + "b\n" * 900 + "\",c\nd,e\n"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    raw = logs.scan_logs(spark, str(tmp_path), blank=True)
    raw.write.parquet(str(tmp_path / "archive"))
    raw = spark.read.parquet(str(tmp_path / "archive"))
    assert raw.select("file", "split_start").distinct().count() > 20
    headers = logs.detect_format(logs.file_headers(raw.where("value != ''")))
    found = records.with_numbers(records.places(raw, headers))
    got = {}
    for r in records.records(raw, headers, found).collect():
        got.setdefault(r["file"].rsplit("/", 1)[1], []).append((r["line_no"], r["value"]))
    for name, text in texts.items():
        assert sorted(got[name]) == plain_records(text, "\t" if name.endswith("tsv") else ","), name


def test_plain_files_are_numbered_without_a_shuffle_of_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text("datetime,ClientIP,login\n" + 'a,"b",c\n' * 50 + "\n\n")
    raw = logs.scan_logs(spark, str(tmp_path), blank=True)
    headers = logs.detect_format(logs.file_headers(raw.where("value != ''")))
    found = records.with_numbers(records.places(raw, headers))
    found.write.parquet(str(tmp_path / "places"))
    plan = records.records(raw, headers, spark.read.parquet(str(tmp_path / "places")))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Window" not in plan


def test_ingest_and_reparse_of_one_upload(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(
        'datetime,ClientIP,login,useragent,respcode\n2024-03-14 08:00:02,10.0.0.1,ann,"Mozilla\n\n (X11)",200\n\n2024-03-14 08:00:03,10.0.0.2,bob,"x",404\n')
    (tmp_path / "in" / "b.csv").write_text("datetime,ClientIP\n2024-03-14 08:00:02,10.0.0.1\n")
    root = str(tmp_path / "root")
    for run in ("r1", "r2"):
        ingest_files(spark, str(tmp_path / "in"), root, "o1", "own", NOW, run, buckets=2)
    entries = versions.read_committed(spark, root, "entries")
    first = versions.read_committed(spark, root, "uploads").where("filename = 'a.csv'").first()
    assert (first["line_count"], first["parsed_count"]) == (3, 2)
    mine = entries.where(F.col("upload_id") == first["id"])
    assert [(r["line_no"], r["username"], r["user_agent"]) for r in mine.orderBy("line_no").collect()] == [
        (2, "ann", "Mozilla\n\n (X11)"), (3, "bob", "x")]
    again = reparse_upload(spark, root, first["object_key"], NOW)
    assert sorted(map(str, again.collect())) == sorted(map(str, mine.select(again.columns).collect()))
    assert archived_lines(spark, root, first["object_key"]).count() == 6
    with pytest.raises(KeyError):
        archived_lines(spark, root, "o1/own/none")


def test_lines_of_quoted_files_are_dealt_by_split(spark, tmp_path, small_splits):
    (tmp_path / "in").mkdir()
    text = odd_text(5, 250) + 'a,"never closed\nb,c\n'
    (tmp_path / "in" / "a.csv").write_text(text)

    def write(df, name):
        df.write.parquet(str(tmp_path / name))
        return spark.read.schema(df.schema).parquet(str(tmp_path / name))
    raw = write(logs.scan_logs(spark, str(tmp_path / "in"), blank=True), "archive")
    headers = write(logs.detect_format(logs.file_headers(raw.where("value != ''"))), "headers")
    found = write(records.with_numbers(records.places(raw, headers)), "places")
    got = records.records(raw, headers, found, write)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "split_start" in plan and not re.search(r"hashpartitioning\(file#\d+, \d+", plan)
    assert sorted((r["line_no"], r["value"]) for r in got.collect()) == plain_records(text)
