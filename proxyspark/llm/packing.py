"""Best-fit packing of documents into sequences of a fixed number of tokens.

Large items (over a third of a sequence) are matched first, at most two to a
sequence, each with the largest that fits beside it; smaller ones then go, in
falling size, into the tightest gap that holds them. Which lengths share a
sequence depends on the lengths alone, so the plan is made from the histogram
of lengths: at most ``capacity`` counts, however many documents there are. A
plan step puts ``count`` items of one length, by their rank among the items of
that length, into consecutive sequences at one offset. The items find their
step by length and rank.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from proxyspark.llm.common import cut, lean, rows_batch
from proxyspark.llm.tokens import encoder

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PLACED = f"{_PIECE}, sequence_id long, offset long"
#: Items of one length and salt that are ranked together.
RANKED_TOGETHER = 500


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096, with_ids: bool = False) -> DataFrame:
    """Every whole text as ids and ``end_id``, cut every ``capacity`` ids.

    Null or empty text is the end id alone. Each row has pieces of its own,
    also where rows repeat. ``with_ids`` adds the ids as an array.
    """
    ddl = f"{_PIECE}, ids array<int>" if with_ids else _PIECE

    def run(batches):
        enc = encoder(tokenizer)
        end = np.array([end_id], "<u4")
        for batch in batches:
            out = [[] for _ in ddl.split(", ")]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.concatenate([np.frombuffer(enc.encode(text.as_py() or ""), f"<u{enc.width}").astype("<u4"), end])
                for k, lo in enumerate(range(0, len(ids), capacity)):
                    part = ids[lo:lo + capacity]
                    row = [doc_id, k, lo, len(part), zlib.crc32(part.tobytes())]
                    for column, value in zip(out, row + [part.astype(np.int32)] * with_ids):
                        column.append(value)
            yield rows_batch(ddl, out)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), ddl)


def plan(histogram: dict[int, int], capacity: int = 4096) -> list[tuple[int, int, int, int, int]]:
    """Steps ``(length, first rank, count, first sequence, offset)``."""
    left = {n: c for n, c in histogram.items() if c}
    used = dict.fromkeys(left, 0)
    steps, gaps, open_gaps, next_sequence = [], {}, [], 0

    def put(length, count, sequence, gap):
        """``count`` items into as many sequences that have ``gap`` left each."""
        steps.append((length, used[length], count, sequence, capacity - gap))
        used[length] += count
        left[length] -= count
        return gap - length

    def keep(gap, sequence, count):
        if gap:
            if gap not in gaps:
                bisect.insort(open_gaps, gap)
                gaps[gap] = []
            gaps[gap].append((sequence, count))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        if not left[a]:
            large.pop()
            continue
        at = bisect.bisect_right(large, capacity - a) - 1
        while at >= 0 and (not left[large[at]] or (large[at] == a and left[a] < 2)):
            if not left[large[at]]:
                large.pop(at)
            at -= 1
        b = large[at] if at >= 0 else None
        n = left[a] if b is None else left[a] // 2 if b == a else min(left[a], left[b])
        gap = put(a, n, next_sequence, capacity)
        if b is not None:
            gap = put(b, n, next_sequence, gap)
        keep(gap, next_sequence, n)
        next_sequence += n
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[length]:
            at = bisect.bisect_left(open_gaps, length)
            if at == len(open_gaps):
                n = max(1, left[length] // (capacity // length))
                keep(put(length, n, next_sequence, capacity), next_sequence, n)
                next_sequence += n
                continue
            gap = open_gaps[at]
            sequence, count = gaps[gap].pop()
            n = min(count, left[length])
            if count > n:
                gaps[gap].append((sequence + n, count - n))
            if not gaps[gap]:
                del gaps[gap]
                open_gaps.pop(at)
            keep(put(length, n, sequence, gap), sequence, n)
    return steps


def ranked(items: DataFrame, largest: int, together: int = RANKED_TOGETHER) -> DataFrame:
    """``items`` with ``_rank``, from 0 within each ``length``; lengths that many
    items share are salted, ranked by salt, and shifted by the salts before."""
    salts = -(-max(1, largest) // together)
    salted = items.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    bases = (salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
             .withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    order = W.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    return (salted.withColumn("_rank", F.row_number().over(order) - 1).join(bases, ["length", "_salt"])
            .withColumn("_rank", F.col("_rank") + F.col("_base")).drop("_base", "_salt"))


def pack(items: DataFrame, capacity: int = 4096) -> DataFrame:
    """``pieces`` rows with ``sequence_id`` and ``offset``. An empty table gives none.

    The plan goes to every task. Its size is bounded by the number of lengths
    and gaps, which ``capacity`` bounds, not by the number of documents.
    """
    items = cut(items, "pieces")
    counts = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}
    steps = np.array(sorted(plan(counts, capacity)), np.int64).reshape(-1, 5)
    shared = items.sparkSession.sparkContext.broadcast(steps)

    def place(batches):
        steps = shared.value
        keys = steps[:, 0] << 44 | steps[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            step = steps[np.searchsorted(keys, length << 44 | rank, "right") - 1]
            columns = [batch.column(c.split()[0]) for c in _PIECE.split(", ")]
            yield rows_batch(_PLACED, columns + [step[:, 3] + rank - step[:, 1], step[:, 4]])

    return ranked(items, max(counts.values(), default=0)).mapInArrow(place, _PLACED)
