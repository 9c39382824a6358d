"""Merkle manifest, whitening and top-k, against plain restatements."""

import hashlib
import zlib

import numpy as np
import pytest

from proxyspark.llm import merkle, registry, topk, whitening
from proxyspark.llm.common import table
from tests.llm.conftest import rows_of

SMALL = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, n long, score string, _x int"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, e, 1, 5, "s", 2) for i, e in rows], VECTORS)


# --- manifest -----------------------------------------------------------------------------

def plain_hash(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return plain_hash("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def plain_tree(leaves):
    """Root, and per leaf its siblings and its way up."""
    ways, row, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(row) > 1:
        for way, i in zip(ways, at):
            run = row[i - i % 3:i - i % 3 + 3]
            way.append((i % 3, run[:i % 3] + run[i % 3 + 1:]))
        at = [i // 3 for i in at]
        row = [plain_hash(row[i:i + 3]) for i in range(0, len(row), 3)]
    return row[0], ways


def plain_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)"""
    def changed(r):
        odd = r[0] is None or zlib.crc32(str(r[0]).encode()) % 2
        return r if odd or r[4] is None else (*r[:4], r[4].replace("\n", ""))
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, plain_leaf(r), plain_leaf(changed(r)), r[0]))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([g[2] for g in sorted(groups[s])]) for s in order}
    root, tops = plain_tree([trees[s][0] for s in order])
    out = []
    for s, top in zip(order, tops):
        for (_, _, leaf, other, doc_id), way in zip(sorted(groups[s]), trees[s][1]):
            folded = other
            for own, others in way + top:
                folded = plain_hash(others[:own] + [folded] + others[own:])
            proof = plain_hash([x for _, others in way + top for x in others])
            out.append((doc_id, leaf, trees[s][0], root, proof, folded, folded == root))
    return sorted(out, key=repr)


def manifest_rows(df):
    return rows_of(df, "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def test_op11_equals_plain_trees(spark):
    docs = [tuple(r) for r in table(spark, SMALL, "documents").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = manifest_rows(registry.op11_merkle(spark, SMALL))
    assert got == plain_manifest(docs)
    assert {r[6] for r in got} == {True, False}


def test_manifest_over_several_tiers_and_odd_rows(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string, grp string, pos int, leaf int, total string"
    big = [(i * 7, "hot", "en", i, f"line {i}\nline", "g", 1, 2, "t") for i in range(1500)]
    odd = [(None, None, None, None, None), (None, "", None, None, ""), (5, "é", "x", 0, "ü\n"), (5, "é", "x", 0, "ü\n"), (5, "é", "y", 0, "\n"),
           (2**62, "z", None, 1, "long " * 100_000 + "\n"), (-1, "hot", None, None, "\n\n"), (None, "hot", None, None, "no id\n"),
           (1, None, "a", 2, "x"), (6, "=", "a", 2, "x\n")]
    rows = big + [(*r, "g", 1, 2, "t") for r in odd]
    got = manifest_rows(merkle.verify(spark.createDataFrame(rows, schema).repartition(5)))
    assert got == plain_manifest([r[:5] for r in rows])


def test_many_groups_make_tiers_over_groups(spark):
    rows = [(i, f"s{i}", None, 1, f"t\n{i}") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert manifest_rows(merkle.verify(df)) == plain_manifest(rows)
    assert merkle.verify(df.limit(0)).count() == 0
    assert manifest_rows(merkle.verify(df.where("doc_id = 3"))) == plain_manifest(rows[3:4])


@pytest.mark.parametrize("levels", range(1, 8))
def test_layout_is_a_bijection_that_keeps_subtrees_together(levels):
    spots = [int(p) for d in range(levels) for p in merkle.place(levels, d, np.arange(3 ** d))]
    assert sorted(spots) == list(range(merkle.tree_size(levels)))
    assert merkle.place(levels, 0, 0) == 0
    top = levels // 2
    if top:  # every bottom subtree is one stretch
        size = merkle.tree_size(levels - top)
        for j in range(3 ** top):
            inside = [int(merkle.place(levels, top + d, j * 3 ** d + i)) for d in range(levels - top) for i in range(3 ** d)]
            assert sorted(inside) == list(range(min(inside), min(inside) + size))


# --- whitening ------------------------------------------------------------------------------

def plain_whitening(rows, shown=8):
    good = [(i, e) for i, e in rows if e is not None and all(c is not None and np.isfinite(c) for c in e)]
    width = max(len(e) for _, e in good)
    x = np.array([[int(np.floor(1024 * float(c))) + 100_000 for c in e] + [0] * (width - len(e)) for _, e in good], np.int64)
    n, s = len(x), x.sum(0)
    apart = (n * x - s) / n
    v = apart.T @ apart / n
    values, vectors = np.linalg.eigh(v)
    far = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s)) for r in x]
    return good, n, far, values[::-1][:shown], vectors[:, ::-1][:, :shown], apart, np.trace(v)


def check_whitening(df, rows):
    good, n, far, e, vectors, apart, trace = plain_whitening(rows)
    got = df.orderBy("vec_id", "component").collect()
    assert len(got) == len(good) * len(e)
    assert len({r["identity_error"] for r in got}) <= 1 and all(r["identity_error"] < 1e-9 for r in got)
    order = sorted(range(len(good)), key=lambda i: good[i][0])
    y = np.array([r["whitened"] for r in got], float).reshape(len(good), -1)
    want = apart[order] @ vectors / np.sqrt(e)
    for c in range(len(e)):
        sign = np.sign(y[:, c] @ want[:, c])
        assert np.allclose(y[:, c] * sign, want[:, c], atol=1e-7 * np.abs(want).max())
        assert all(abs(r["explained"] - e[c] / trace) <= 1e-10 for r in got[c::len(e)])
    assert [r["deviation"] for r in got[::len(e)]] == [far[i] for i in order]
    assert {r["n"] for r in got} == {n}


def test_op12_equals_a_plain_eigendecomposition(spark):
    rows = [tuple(r) for r in table(spark, SMALL, "embeddings").select("vec_id", "embedding").collect()]
    check_whitening(registry.op12_whitening(spark, SMALL), rows)


def test_whitening_combines_many_partitions_and_drops_bad_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=10).astype(np.float32).tolist()) for i in range(400)] + [
        (900, None), (901, [1.0, None] + [0.0] * 8), (902, [float("nan")] * 10), (903, [float("inf")] + [0.0] * 9)]
    check_whitening(whitening.whiten(vectors_of(spark, rows).repartition(40)), [(i, e) for i, e in rows])


def test_whitening_without_spread_and_without_rows(spark):
    alike = whitening.whiten(vectors_of(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])])).collect()
    assert len(alike) == 6 and all(r["whitened"] is None and r["deviation"] == 0 and r["explained"] == 0.0 for r in alike)
    assert alike[0]["identity_error"] == 0.0 and [r["vec_id"] for r in alike].count(None) == 2
    flat = whitening.whiten(vectors_of(spark, [(i, [float(i), 2.0, 0.0]) for i in range(5)])).collect()
    assert [r["whitened"] is None for r in sorted(flat, key=lambda r: (r["component"], r["vec_id"]))] == [False] * 5 + [True] * 10
    assert whitening.whiten(vectors_of(spark, [])).count() == 0
    assert whitening.whiten(vectors_of(spark, [(1, None)])).count() == 0
    far = whitening.whiten(vectors_of(spark, [(1, [1e8]), (2, [-1e8]), (3, [1e30])])).collect()
    # 2 * 1024e8 from the mean, times n = 2, squared: no long holds it.
    assert {r["vec_id"] for r in far} == {1, 2} and all(r["deviation"] is None and abs(abs(r["whitened"]) - 1) < 1e-12 for r in far)


@pytest.mark.parametrize("rows, width, parts", [(300, 12, 1), (200, 12, 6), (9, 12, 3), (50, 1, 2)])
def test_rank_one_updates_equal_a_whole_decomposition(rows, width, parts):
    rng = np.random.default_rng(rows)
    for x in (rng.normal(size=(rows, width)), rng.integers(0, 2, (rows, width)).astype(float), np.repeat(rng.normal(size=(1, width)), rows, 0),
              rng.normal(size=(rows, width)) * np.logspace(6, -6, width)):
        total = None
        for part in np.array_split(x, parts):
            s = whitening.Spectrum(width)
            for row in part:
                s.add(row)
            total.merge(s) if total else None
            total = total or s
        scatter = (x - x.mean(0)).T @ (x - x.mean(0))
        size = max(np.abs(scatter).max(), 1e-12)
        assert np.abs(total.basis @ np.diag(total.values) @ total.basis.T - scatter).max() < 1e-11 * size
        assert np.abs(total.basis.T @ total.basis - np.eye(width)).max() < 1e-11
        assert total.n == rows and np.allclose(total.mean, x.mean(0))


# --- top-k ------------------------------------------------------------------------------------

def plain_top(rows, queries, k=5):
    def whole(vectors):
        return sorted({(i, tuple(int(np.floor(256 * float(c))) for c in e)) for i, e in vectors
                       if e is not None and all(c is not None and np.isfinite(c) and abs(c) < 2**17 for c in e)}, key=repr)
    out = []
    for qi, q in whole(queries):
        scored = sorted((-sum(a * b for a, b in zip(q, c)), i is None, i or 0, i) for i, c in whole(rows) if i is None or i != qi)
        out += [(qi, r + 1, s[3], -s[0]) for r, s in enumerate(scored[:k])]
    return sorted(out, key=repr)


def top_rows(df):
    return rows_of(df, "query_id", "rank", "vec_id", "score")


def test_op13_equals_brute_force(spark):
    rows = [tuple(r) for r in table(spark, SMALL, "embeddings").select("vec_id", "embedding").collect()]
    assert top_rows(registry.op13_topk(spark, SMALL)) == plain_top(rows, [r for r in rows if r[0] % 50 == 0])


def test_top_k_over_many_shards_with_ties_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.integers(-2, 3, 6) / 256]) for i in range(500)]
    rows += [(7, rows[8][1]), (9, rows[9][1]), (None, rows[3][1]), (600, None), (601, [1.0, None]), (602, [float("nan")] * 6), (603, [1e30] * 6),
             (604, []), (605, [0.5]), (606, [0.1] * 9), (607, [0.0] * 6), (650, [-0.25] * 6)]
    df = vectors_of(spark, rows)
    queries = [r for r in rows if r[0] is not None and r[0] % 50 == 0 or r[0] == 7]
    for shard_rows in (40, 8192):
        got = topk.top_k(df, df.where("vec_id % 50 = 0 OR vec_id = 7"), shard_rows=shard_rows)
        assert top_rows(got) == plain_top(rows, queries)
    few = vectors_of(spark, [(0, [1.0]), (1, [2.0]), (2, [2.0])])
    assert top_rows(topk.top_k(few, few.where("vec_id = 0"))) == [(0, 1, 1, 256 * 512), (0, 2, 2, 256 * 512)]
    alone = vectors_of(spark, [(0, [1.0])])
    assert topk.top_k(alone, alone).count() == 0
    assert topk.top_k(vectors_of(spark, []), vectors_of(spark, [])).count() == 0


def test_rounds_end_early_only_where_all_others_are_ruled_out():
    rng = np.random.default_rng(4)
    values = rng.integers(-20, 20, (2000, 8))
    values[5] = 100
    index = topk.Shard(np.arange(2000), np.zeros(2000, bool), values)
    for query in (values[5], values[6], np.zeros(8, int), -values[5]):
        found = set(index._possible(query, np.zeros(2000, bool), 5).tolist())
        scores = values @ query
        assert {i for i in range(2000) if scores[i] >= np.sort(scores)[-5]} <= found
    assert len(index._possible(values[5], np.zeros(2000, bool), 1)) < 2000
