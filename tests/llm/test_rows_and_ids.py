"""Rows that share an id, ids near the ends of 64 bits, bytes that are no UTF-8."""

import hashlib

import corpus_pipeline
from pyspark.sql import functions as F

from proxyspark.llm import minhash, warc
from tests.llm.conftest import rows_of


def test_every_row_of_an_id_keeps_its_own_text(spark, docs_of, tmp_path):
    first, second = "secret = abcdef123456 first text", "another text entirely with no key"
    docs = docs_of([(1, first, "en"), (1, second, "en"), (2, "12 34", "en"), (2, "words beside a namesake", "en"), (None, "no id but words", "en")])
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    kept = corpus_pipeline.language(spark, docs, str(tmp_path))
    assert {r[1] for r in rows_of(kept, "doc_id", "text")} == {first, second, "words beside a namesake", "no id but words"}
    clean = corpus_pipeline.secrets(spark, docs, str(tmp_path))
    assert rows_of(clean, "doc_id", "text", "n_chars") == rows_of(docs.withColumn("text", F.when(
        F.col("text") == first, "secret = <secret> first text").otherwise(F.col("text"))).withColumn("n_chars", F.length("text").cast("long")),
        "doc_id", "text", "n_chars")
    window = "one two three four five six seven eight nine ten"
    spark.createDataFrame([(7, window)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = docs_of([(1, f"it says {window} here"), (1, second), (None, "clean"), (3, None)]).select("doc_id", "text", "lang", "source", "n_chars")
    left = corpus_pipeline.decontaminate_(spark, docs, str(tmp_path))
    assert {r[0] for r in rows_of(left, "text")} == {second, "clean", None}


def test_ids_near_the_ends_of_64_bits_are_linked(spark, docs_of):
    top = 2 ** 63 - 1
    texts = ["the same words stand here in every one of these rows " * 3] * 4
    docs = docs_of([*zip([top, top - 1, top - 2, top - 3], texts), (-2 ** 63, "quite another text with other words in it"), (-2 ** 63 + 1, texts[0] + "x")])
    edges = spark.createDataFrame([(top - i, top - i - 1) for i in range(6)] + [(-2 ** 63, -2 ** 63 + 1)], "a long, b long")
    assert {tuple(r) for r in minhash.components(edges).collect()} == {(top - i, top - 6) for i in range(7)} | {
        (-2 ** 63, -2 ** 63), (-2 ** 63 + 1, -2 ** 63)}
    got = {r["doc_id"]: r["component_id"] for r in minhash.link(docs).collect()}
    assert {got[top - i] for i in range(4)} == {-2 ** 63 + 1} and got[-2 ** 63] == -2 ** 63


def test_pages_that_are_no_utf8(spark):
    bad = b"<html>\xff\xfe page \xc3" + b"x" * 2000
    pages = spark.createDataFrame([(1, "http://a.io", bad), (2, "http://a.io", bad), (3, None, b"\xff")], "page_id long, url string, b binary")
    got = warc.archive(spark, pages.select("page_id", "url", F.col("b").cast("string").alias("html")))
    rows = {r["page_id"]: r for r in got.collect()}
    assert rows[2]["record_type"] == "response" and rows[1]["refers_to"] == 2 and rows[3]["payload_bytes"] == 1
    assert rows[1]["payload_digest"] == hashlib.sha1(bad).hexdigest() and rows[2]["payload_bytes"] == len(bad)
    assert rows[2]["html"] == bad.decode(errors="replace")
