"""The approximate index against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from proxyspark.operators import search, vector_index

SMALL = "/root/testdata/sf0.01"


def exact(ids, vectors, asked, k):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = {}
    for q in asked:
        scores = unit @ unit[ids.index(q)]
        out[q] = sorted((-s, i) for s, i in zip(scores, ids) if i != q)[:k]
    return {q: {i for _, i in found} for q, found in out.items()}


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(40, 16)) * 4
    rows = [(i, [float(x) for x in middle[i % 40 if i % 3 else 0] + rng.normal(size=16)], f"n{i}") for i in range(4000)]
    odd = [(9000, None, "a"), (9001, [0.0] * 16, "b"), (9002, [1.0], "c"), (9003, [float("nan")] * 16, "d"), (9004, [None] * 16, "e")]
    df = spark.createDataFrame(rows + odd, "finding_id long, embedding array<double>, kind string")
    return df.repartition(4), [r[0] for r in rows], np.array([r[1] for r in rows])


def test_clusters_need_few_cells_and_recall_holds(spark, clustered, tmp_path):
    df, ids, vectors = clustered
    path = str(tmp_path / "index")
    probes = vector_index.build_index(df, path)
    cells = spark.read.parquet(f"{path}/centres").count()
    assert spark.read.parquet(f"{path}/cells").count() == 4000 and probes <= cells / 2
    asked = [i for i in ids if i % 50 == 0]
    got = vector_index.search_each(spark, path, df.where(F.col("finding_id") % 50 == 0), 10)
    found = {}
    for r in got.collect():
        found.setdefault(r["query_id"], set()).add(r["id"])
    want = exact(ids, vectors, asked, 10)
    assert set(found) == set(asked) and all(q not in f and len(f) == 10 for q, f in found.items())
    assert np.mean([len(found[q] & want[q]) / 10 for q in asked]) >= 0.9


def test_one_search_reads_probed_folders_and_ranks_exactly(spark, clustered, tmp_path):
    df, ids, vectors = clustered
    path = str(tmp_path / "index")
    vector_index.build_index(df, path)
    query = [float(x) for x in vectors[7]]
    got = vector_index.search_index(spark, path, query, 5)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]
    full = search.search_findings_vector(df.where(F.col("finding_id") < 9000), query, 5)
    assert [(r["finding_id"], round(r["rank"], 9)) for r in got.collect()] == [(r["finding_id"], round(r["rank"], 9)) for r in full.collect()]


def test_all_cells_are_the_exact_search_in_small_blocks(spark, clustered, tmp_path, monkeypatch):
    df, ids, vectors = clustered
    monkeypatch.setattr(vector_index, "BLOCK", 64)
    path = str(tmp_path / "index")
    vector_index.build_index(df.where(F.col("finding_id") < 1500), path, cells=6)
    got = vector_index.search_each(spark, path, df.where((F.col("finding_id") < 1500) & (F.col("finding_id") % 10 == 0)), 7, probes=6)
    found = {}
    for r in got.collect():
        found.setdefault(r["query_id"], set()).add(r["id"])
    assert found == exact(ids[:1500], vectors[:1500], [i for i in ids[:1500] if i % 10 == 0], 7)


def test_nothing_to_index(spark, clustered, tmp_path):
    df, _, vectors = clustered
    path = str(tmp_path / "index")
    vector_index.build_index(df.where(F.col("finding_id") < 0), path)
    assert vector_index.search_index(spark, path, [1.0] * 16, 5).count() == 0


def test_recall_on_the_given_vectors(spark, tmp_path):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet").select(F.col("vec_id").alias("finding_id"), "embedding")
    path = str(tmp_path / "index")
    vector_index.build_index(df, path)
    table = df.toPandas()
    ids = [int(i) for i in table["finding_id"]]
    asked = [i for i in ids if i % 50 == 0]
    found = {}
    for r in vector_index.search_each(spark, path, df.where(F.col("finding_id") % 50 == 0), 10).collect():
        found.setdefault(r["query_id"], set()).add(r["id"])
    want = exact(ids, np.array(list(table["embedding"]), dtype="f8"), asked, 10)
    assert np.mean([len(found[q] & want[q]) / 10 for q in asked]) >= 0.9
