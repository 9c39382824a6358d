"""Quality rules: gradient-boosted trees over document statistics.

Trees are grown on binned features by second-order gain of the logistic loss.
On chosen features the score may only fall (or only rise): a split that would
break that is refused, and both sides of an accepted one are held to their side
of its middle, so the whole forest is monotonic. The forest is then flattened
into arrays of nodes, and a batch of documents walks down all trees at once.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proxyspark.llm.common import as_bytes, rows_batch

#: The forest is fitted on at most so many labelled documents, those with the
#: smallest hash of their id.
SAMPLE = 8_000
#: Documents whose probability of good quality is at least this are kept.
THRESHOLD = 0.5
MIN_WORDS, REPEAT_PERCENT, REPEAT_WINDOW = 20, 30, 8

#: Features by name, and how the score may move with them: -1 only down.
FEATURES = {
    "words": 0, "word_length": 0, "symbols_per_char": -1, "dup_line_share": -1, "repeat_share": -1,
    "upper_share": -1, "digit_share": -1, "distinct_share": 0, "exclaim_per_word": -1, "words_per_line": 0,
    "stop_per_word": 0, "bare_short_share": 0,
}

_WHITE = b" \t\n\x0b\x0c\r"
_COUNTS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_SCORED = f"{_COUNTS}, base_failed boolean, kept boolean, score double"


def repeated_words(ids: np.ndarray, window: int = REPEAT_WINDOW) -> int:
    """Words inside a window of ``window`` words that the text holds at least twice."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    # Equal windows get equal ranks: those of pairs of ranks of shorter windows.
    ranks, length = np.unique(ids, return_inverse=True)[1].astype(np.int64), 1
    while length < window:
        step = min(length, window - length)
        pairs = ranks[:-step] * len(ids) + ranks[step:]
        ranks = np.unique(pairs, return_inverse=True)[1]
        length += step
    hit = np.flatnonzero(np.bincount(ranks)[ranks] > 1)
    if not len(hit):
        return 0
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def statistics(text: bytes | None) -> tuple[list[int], list[float]]:
    """The counts of a whole text, and its features in the order of ``FEATURES``."""
    text = text or b""
    words = text.split()
    n = len(words)
    if not n:
        return [0, 0, len(text) - len(text.translate(None, b"#*$%&|<>")), 0, 0], [0.0] * len(FEATURES)
    solid = text.translate(None, _WHITE)
    # A code point has one byte that is not a continuation byte.
    chars = len(solid.translate(None, bytes(range(0x80, 0xC0))))
    symbols = len(text) - len(text.translate(None, b"#*$%&|<>"))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    dup = len(lines) - len(set(lines))
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    repeat = repeated_words(ids)
    upper = len(solid) - len(solid.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(solid) - len(solid.translate(None, b"0123456789"))
    features = [
        float(n), chars / n, symbols / chars, dup / len(lines), repeat / n, upper / chars, digits / chars,
        len(seen) / n, text.count(b"!") / n, n / len(lines), text.count(b".") / n,
        sum(len(w) <= 3 for w in words) / n,
    ]
    return [n, chars, symbols, dup, repeat], features


class Forest:
    """Flattened trees: for node ``i``, go left where ``feature[i] <= threshold[i]``;
    a leaf points to itself and holds ``value[i]``."""

    def __init__(self, feature, threshold, left, right, value, roots, base, depth):
        self.feature, self.threshold, self.left, self.right = feature, threshold, left, right
        self.value, self.roots, self.base, self.depth = value, roots, base, depth

    def margin(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            down = x[row, self.feature[at]] <= self.threshold[at]
            at = np.where(down, self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -60, 60)))

    def arrays(self) -> tuple:
        return (self.feature, self.threshold, self.left, self.right, self.value, self.roots, self.base, self.depth)


def fit(x: np.ndarray, y: np.ndarray, direction: list[int], trees: int = 80, depth: int = 3, rate: float = 0.15,
        bins: int = 32, ridge: float = 1.0, least: float = 5.0) -> Forest:
    """A forest for labels 0/1. Classes weigh alike, so that a rare one counts.

    ``direction`` has -1, 0 or 1 per feature. With one class only, or no rows,
    the forest has no trees and always answers that class (or one half).
    """
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    one = y.mean() if len(y) else 0.5
    base = float(np.log(one / (1 - one))) if 0 < one < 1 else 20.0 * (2 * one - 1)
    if len(y) and 0 < one < 1:
        base = 0.0
        weight = np.where(y == 1, 0.5 / one, 0.5 / (1 - one))
        edges = [np.unique(np.quantile(x[:, j], np.arange(1, bins) / bins)) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)], axis=1)
        margin = np.zeros(len(y))

        def leaf(g, h, low, high):
            return float(np.clip(-g / (h + ridge), low, high))

        def node(grad, hess, rows, low, high, level):
            me = len(feature)
            for column, v in ((feature, 0), (threshold, 0.0), (left, me), (right, me), (value, 0.0)):
                column.append(v)
            g, h = grad[rows].sum(), hess[rows].sum()
            best = (1e-6, None)
            for j in range(x.shape[1]) if level < depth else ():
                gl = np.cumsum(np.bincount(binned[rows, j], grad[rows], len(edges[j]) + 1))[:-1]
                hl = np.cumsum(np.bincount(binned[rows, j], hess[rows], len(edges[j]) + 1))[:-1]
                hr = h - hl
                wl, wr = np.clip(-gl / (hl + ridge), low, high), np.clip(-(g - gl) / (hr + ridge), low, high)
                gain = gl * gl / (hl + ridge) + (g - gl) ** 2 / (hr + ridge) - g * g / (h + ridge)
                gain[(hl < least) | (hr < least) | (direction[j] * (wr - wl) < 0)] = 0
                if len(gain) and gain.max() > best[0]:
                    k = int(gain.argmax())
                    best = (gain[k], (j, k, wl[k], wr[k]))
            if best[1] is None:
                value[me] = rate * leaf(g, h, low, high)
                margin[rows] += value[me]
                return me
            j, k, wl, wr = best[1]
            middle = (wl + wr) / 2
            bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}
            side = binned[rows, j] <= k
            feature[me], threshold[me] = j, float(edges[j][k])
            left[me] = node(grad, hess, rows[side], *bounds[direction[j]][0], level + 1)
            right[me] = node(grad, hess, rows[~side], *bounds[direction[j]][1], level + 1)
            return me

        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            roots.append(node(weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6), np.arange(len(y)), -8.0, 8.0, 0))
    return Forest(np.array(feature, np.int32), np.array(threshold), np.array(left, np.int32), np.array(right, np.int32),
                  np.array(value), np.array(roots, np.int32), base, depth)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """A forest from ``labels.quality`` (0 or 1) and the statistics of the labelled texts.

    Labels that are null, or for unknown documents, teach nothing; of repeated
    ids one row counts. At most ``sample`` rows of features reach the driver.
    """
    chosen = (labels.where("quality IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
              .agg(F.min(F.col("quality").cast("int")).alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .join(chosen, "doc_id").select("doc_id", "text", "label"))
    ddl = "doc_id long, label int, " + ", ".join(f"f{k} double" for k in range(len(FEATURES)))

    def features(batches):
        for batch in batches:
            found = [statistics(t)[1] for t in as_bytes(batch.column(1))]
            if found:
                yield rows_batch(ddl, [batch.column(0), batch.column(2), *zip(*found)])

    got = rows.mapInArrow(features, ddl).dropDuplicates(["doc_id"]).orderBy("doc_id").toPandas()
    x = got[[f"f{k}" for k in range(len(FEATURES))]].to_numpy(float)
    return fit(x, got["label"].to_numpy(float), list(FEATURES.values()))


def judge(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD) -> DataFrame:
    """Counts, base rule and verdict of every row's whole text; null text has no words.

    ``base_failed``: under 20 words, or over 30 % of words in repeated windows.
    ``score`` is the forest's probability of good quality; such a document is
    kept if the base rule holds and its score reaches ``threshold``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(forest.arrays())  # a few hundred nodes

    def run(batches):
        model = Forest(*shared.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            counts, features = zip(*map(statistics, as_bytes(batch.column(1))))
            score = model.probability(np.array(features))
            failed = [c[0] < MIN_WORDS or 100 * c[4] > REPEAT_PERCENT * c[0] for c in counts]
            kept = [not f and s >= threshold for f, s in zip(failed, score)]
            yield rows_batch(_SCORED, [batch.column(0), *zip(*counts), failed, kept, score])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _SCORED)
