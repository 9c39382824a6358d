"""Exact top-k by inner product from an impact-ordered index, score at a time.

Components become integers, ``floor(scale * x)``. Rows are dealt to shards of
about ``SHARD_ROWS``; a task holds one shard's index at a time and streams the
queries past it in blocks, so memory depends on neither table.

In a shard every dimension is a term. Its values are cut into ``LEVELS`` steps of
equal width, and its rows lie in segments of one step each. For a query with
weight w in a dimension, a row's impact is w times its distance from that end of
the dimension's range where the product is least; so all impacts are at least
zero and a query's score is their sum plus a constant. Segments of all dimensions
are taken by falling w * step, a round of them at a time, and two sums are kept
per row: the impact that is certain so far and the number of dimensions seen. What
a row can still gain is at most the sum of the largest caps of as many dimensions
as it lacks, plus what lies inside the steps. A row whose upper bound is below the
k-th certain sum can't be among the k best. That is the proof: only the others, the
possible members, are scored exactly, and the rounds end when these are few or
when no segment is left, never otherwise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proxyspark.llm.common import cut, rows_batch

#: Rows of a shard; its index takes about 64 bytes a component while it is built.
SHARD_ROWS = 8192
#: Steps of a dimension's range.
LEVELS = 16
#: Rounds in which a query's segments are processed.
ROUNDS = 16
#: Largest magnitude of an integer component: sums of products stay within a long.
LARGEST = 1 << 26

_PART = "query_id long, query_digest string, vec_id long, score long"


def whole_components(vector, scale: int, added: int = 0, largest: int = LARGEST):
    """Integer components of a vector, or NULL where it or an entry is missing, not
    finite, or beyond what exact sums in a long can hold."""
    whole = F.transform(vector, lambda c: F.floor(F.lit(scale) * c.cast("double")) + F.lit(added))
    fits = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double") * scale + added) < F.lit(float(largest)), F.lit(False)))
    return F.when(fits, whole)


class Shard:
    """The impact-ordered index of some rows of one width."""

    def __init__(self, ids: np.ndarray, unnamed: np.ndarray, values: np.ndarray):
        self.ids, self.unnamed, self.values = ids, unnamed, values
        self.rows, self.dims = values.shape
        low = values.min(0)
        self.step = (values.max(0) - low) // LEVELS + 1
        self.low, self.high = low, low + self.step * LEVELS - 1
        level = (values - low) // self.step
        self.order = np.argsort(level, 0, kind="stable").T.copy()
        self.ends = np.stack([np.searchsorted(np.sort(level[:, d]), np.arange(LEVELS + 1)) for d in range(self.dims)])

    def top(self, query: np.ndarray, query_id: int | None, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and scores of the k best, by falling score, then id."""
        barred = (self.ids == query_id) & ~self.unnamed if query_id is not None else np.zeros(self.rows, bool)
        found = self._possible(query, barred, min(k, int(self.rows - barred.sum())))
        scores = (self.values[found] * query).sum(1)
        best = np.lexsort((self.ids[found], self.unnamed[found], -scores))[:k]
        return found[best], scores[best]

    def _possible(self, query, barred, k):
        """Rows that may be among the k best; all others are proved not to be."""
        if k <= 0:
            return np.zeros(0, np.int64)
        weight, rising = np.abs(query), query > 0
        # Steps from the end where the product is least, for either sign.
        steps = np.where(rising[:, None], np.arange(LEVELS), np.arange(LEVELS)[::-1])
        impact = weight[:, None] * self.step[:, None] * steps
        counts = np.diff(self.ends, axis=1)
        segments = np.flatnonzero((counts > 0).ravel())
        segments = segments[np.argsort(-impact.ravel()[segments], kind="stable")]
        gains, sizes = impact.ravel()[segments], counts.ravel()[segments]
        dims, levels = np.divmod(segments, LEVELS)
        starts, reach = self.ends[dims, levels], np.cumsum(sizes)
        inside = float((weight * (self.step - 1)).sum())
        # Doubles hold whole numbers below 2**53; beyond, what rounding may take is added.
        inside += float((weight * self.step).sum()) * LEVELS * 2.0 ** -40 if inside > 2.0 ** 48 else 0.0
        sure, seen = np.zeros(self.rows, np.float64), np.zeros(self.rows, np.int64)
        few, taken = max(8 * k, 64), 0
        alive = np.flatnonzero(~barred)
        for r in range(1, ROUNDS + 1):
            until = int(np.searchsorted(reach, reach[-1] * r // ROUNDS, "left")) + 1 if r < ROUNDS else len(segments)
            if until <= taken:
                continue
            part = slice(taken, until)
            rows = np.concatenate([self.order[d, a:a + n] for d, a, n in zip(dims[part], starts[part], sizes[part])])
            sure += np.bincount(rows, np.repeat(gains[part], sizes[part]).astype(np.float64), self.rows)
            seen += np.bincount(rows, minlength=self.rows)
            taken = until
            # Most that a dimension not seen yet can give: its best segment to come.
            caps = np.zeros(self.dims)
            np.maximum.at(caps, dims[taken:], gains[taken:].astype(np.float64))
            most = np.concatenate(([0.0], np.cumsum(np.sort(caps)[::-1])))
            bar = np.partition(sure[alive], len(alive) - k)[len(alive) - k]
            alive = alive[sure[alive] + most[self.dims - seen[alive]] + inside >= bar]
            if len(alive) <= few:
                break
        return alive


def _searcher(k: int):
    """Streams a task's rows, each shard's candidates first, its queries behind."""
    def run(batches):
        shard, parts, index = None, [], None
        for batch in batches:
            names = batch.schema.names
            cols = {n: batch.column(i) for i, n in enumerate(names)}
            shards = cols["_shard"].to_numpy(zero_copy_only=False)
            kinds = cols["_is_query"].to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((np.diff(shards) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, len(shards)]):
                if a == b:
                    continue
                if shards[a] != shard:
                    shard, parts, index = shards[a], [], None
                piece = {n: c.slice(a, b - a) for n, c in cols.items()}
                if not kinds[a]:
                    parts.append(piece)
                    continue
                if index is None:
                    index = _index(parts)
                    parts = []
                if index is not None:
                    yield _answers(index, piece, k)
    return run


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of a matrix; what a shorter list lacks is zero."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), np.int64)
    if len(flat):
        rows = np.repeat(np.arange(len(column)), sizes)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        fits = at < width
        out[rows[fits], at[fits]] = flat[fits]
    return out


def _index(parts: list) -> Shard | None:
    if not parts:
        return None
    column = pa.concat_arrays([p["_x"] for p in parts])
    ids = pa.concat_arrays([p["_id"] for p in parts])
    width = max(int(np.diff(column.offsets.to_numpy()).max(initial=0)), 1)
    return Shard(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), _matrix(column, width))


def _answers(index: Shard, piece: dict, k: int) -> pa.RecordBatch:
    queries = _matrix(piece["_x"], index.dims)
    out = [[], [], [], []]
    for query, query_id, digest in zip(queries, piece["_id"].to_pylist(), piece["_digest"].to_pylist()):
        rows, scores = index.top(query, query_id, k)
        out[0] += [query_id] * len(rows)
        out[1] += [digest] * len(rows)
        out[2] += [None if index.unnamed[r] else int(index.ids[r]) for r in rows]
        out[3] += scores.tolist()
    return rows_batch(_PART, out)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The ``k`` rows of ``vectors`` with the largest integer inner product for
    every row of ``queries`` (both: vec_id, embedding; other columns are ignored).

    Returns query_id, query_digest, rank (from 1), vec_id, score. Ties go to the
    smaller vec_id, a missing one last. A query never finds rows of its own id;
    with fewer than ``k`` others it gets them all. Vectors that are NULL, or hold
    an entry that is NULL, not finite or of a magnitude beyond ``LARGEST`` (no long
    could hold the scores), take no part. What a shorter vector lacks counts as
    zero. Rows that repeat id and vector are one row; an id with several vectors
    gives a list for each, told apart by query_digest. Empty tables give no rows.
    """
    x = whole_components(F.col("embedding"), scale)
    usable = lambda df: df.select(F.col("vec_id").cast("long").alias("_id"), x.cast("array<int>").alias("_x")).where("_x IS NOT NULL").distinct()
    rows = cut(usable(vectors), "vectors")
    shards = max(1, -(-rows.count() // shard_rows))
    # Distinct rows spread evenly, whatever ids repeat.
    dealt = rows.select(F.pmod(F.xxhash64("_id", "_x"), F.lit(shards)).cast("int").alias("_shard"), F.lit(False).alias("_is_query"),
                        "_id", "_x", F.lit(None).cast("string").alias("_digest"))
    asked = usable(queries).select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("_shard"), F.lit(True).alias("_is_query"), "_id", "_x",
        F.sha2(F.array_join(F.col("_x").cast("array<string>"), ","), 256).alias("_digest"))
    streamed = dealt.unionByName(asked).repartition("_shard").sortWithinPartitions("_shard", "_is_query")
    partial = streamed.mapInArrow(_searcher(k), _PART)
    best = Window.partitionBy("query_id", "query_digest").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return partial.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "query_digest", "rank", "vec_id", "score")
