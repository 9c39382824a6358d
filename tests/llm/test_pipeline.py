"""The pipeline against its rules restated, each stage judged on its own input."""

import corpus_pipeline
from proxyspark.llm.common import table
from tests.llm.test_file_operators import TOKENIZERS, WORD, check_packing
from tests.llm.test_text_operators import near_duplicates, plain_base, plain_hits

SMALL = "/root/testdata/sf0.001"


def test_every_stage(spark):
    docs = table(spark, SMALL, "documents")
    items = [tuple(r) for r in table(spark, SMALL, "benchmark").select("item_id", "text").collect()]
    columns, before = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        if name == "pack":
            rows = out.collect()
            break
        assert out.columns == columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        after = {r["doc_id"]: r for r in docs.collect()}
        texts = [(d, r["text"] or "") for d, r in before.items()]
        if name == "language":
            want = {d for d, t in texts if any(c.isalpha() for c in t)}
        elif name == "near_duplicates":
            want = {d for d, (_, root) in near_duplicates(texts).items() if d == root}
        elif name == "decontaminate":
            want = {r[0] for r in plain_hits(texts, items) if not r[5]}
        else:
            want = before.keys()
            for d, r in after.items():
                if r["text"] == before[d]["text"]:
                    assert not plain_base(r["text"]) and r["n_chars"] == before[d]["n_chars"]
                else:
                    assert r["n_chars"] == len(r["text"]) and "<secret>" in r["text"]
        assert after.keys() == set(want), name
        assert name == "secrets" or all(r == before[d] for d, r in after.items())
        before = after
    assert {r["doc_id"] for r in rows} == before.keys()
    for r in rows:
        ids = TOKENIZERS[WORD].encode(before[r["doc_id"]]["text"], add_special_tokens=False).ids + [1]
        assert r["length"] == len(ids[r["start"]:r["start"] + 4096])
    check_packing(rows, 4096)


def test_run_and_odd_rows(spark, docs_of, tmp_path):
    odd = docs_of([(1, None, "en"), (2, "", None), (3, "some words here that stay", "en"), (3, "some words here that stay", "en"),
                   (4, "secret = abcdef123456", "en"), (5, "123", None), (None, "no id here", "en")])
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None), (2, "words here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert [r["doc_id"] for r in rows] == [4]  # the rest: no text, no letter, a benchmark window, or no id
    docs_of([]).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
