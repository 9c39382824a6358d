"""Language identification by rank-order profiles.

A language's profile is its most frequent n-grams (one to three letters, words
marked off by a space), by rank. A document's own profile is compared with each
of them: every n-gram costs by how far its ranks lie apart, or the most there is
if the language lacks it. The language with the smallest sum wins.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from proxyspark.llm.common import carried, kept, lean, rows_batch

#: Ranks kept of a language and of a document.
PROFILE = 400
#: Profiles are learnt from at most so many labelled documents of a language,
#: those with the smallest hash of their id.
SAMPLE_PER_LANGUAGE = 1_000
#: Parts in which a language's rows are sampled first, so that no task sees them all.
PARTS = 1_000
UNKNOWN = "und"

_GRAMS = "lang string, gram long, n long"
_PREDICTED = "doc_id long, lang_pred string, score double"


def letter_table() -> np.ndarray:
    """For every code point: that of its lower case if it is a letter, else 0."""
    table = np.zeros(sys.maxunicode + 1, np.uint32)
    for c in range(sys.maxunicode + 1):
        if chr(c).isalpha():
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def grams_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of each text: ``(text number, gram, count)``, in order.

    A gram holds up to three code points of 21 bits; the space between words is
    code point 32 and never stands alone.
    """
    table = kept("letters", letter_table)
    owners, codes = [], []
    for i, text in enumerate(texts):
        if text:
            codes.append(np.frombuffer(f" {text} ".encode("utf-32-le", "replace"), "<u4"))
            owners.append(np.full(len(codes[-1]), i, np.int64))
    if not codes:
        return (np.zeros(0, np.int64),) * 3
    owner = np.concatenate(owners)
    letter = table[np.concatenate(codes)].astype(np.int64)
    letter[letter == 0] = 32
    both = (letter[1:] == 32) & (letter[:-1] == 32) & (owner[1:] == owner[:-1])
    keep = np.concatenate([[True], ~both])
    letter, owner = letter[keep], owner[keep]
    one = letter != 32
    two = letter[:-1] << 21 | letter[1:]
    three = two[:-1] << 21 | letter[2:]
    inside2, inside3 = owner[1:] == owner[:-1], owner[2:] == owner[:-2]
    middle = letter[1:-1] != 32  # a space only at the ends
    keep3 = inside3 & middle
    who = np.concatenate([owner[one], owner[:-1][inside2], owner[:-2][keep3]])
    gram = np.concatenate([letter[one], two[inside2], three[keep3]])
    # Sorting one number is far quicker than sorting pairs: grams by their place
    # among the distinct ones, below the owner.
    distinct, place = np.unique(gram, return_inverse=True)
    key, count = np.unique(who * len(distinct) + place, return_counts=True)
    return key // len(distinct), distinct[key % len(distinct)], count


def ranks_of(owner: np.ndarray, gram: np.ndarray, count: np.ndarray, top: int):
    """The ``top`` most frequent grams of each owner with their rank from 0; ties by gram."""
    order = np.lexsort((gram, -count, owner))
    owner, gram = owner[order], gram[order]
    first = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, bool)
    start = np.flatnonzero(first)
    rank = np.arange(len(owner)) - np.repeat(start, np.diff(np.append(start, len(owner))))
    keep = rank < top
    return owner[keep], gram[keep], rank[keep]


def portions(batches, limit: int = 250_000):
    """Arrow batches in portions of about ``limit`` characters, a long text alone: the
    arrays of a portion's n-grams take some 200 bytes a character."""
    for batch in batches:
        rows = batch.to_pydict()
        names = list(rows)
        texts, lo, size = rows["text"], 0, 0
        for i, text in enumerate(texts):
            size += len(text or "")
            if size >= limit or i == len(texts) - 1:
                yield {n: rows[n][lo:i + 1] for n in names}
                lo, size = i + 1, 0


def learn(labelled: DataFrame, sample: int = SAMPLE_PER_LANGUAGE, top: int = PROFILE) -> dict[str, list[int]]:
    """Profiles from ``doc_id, text, lang``: each language's grams by rank.

    Rows without text or language teach nothing. The sample is the ``sample``
    rows of a language with the smallest hash of their id, so it does not
    depend on how the table is stored. The first of a whole are among the first of
    its parts, so a language is sampled part by part, then over what is left. The
    result is languages times ``top`` numbers; an empty table gives no profile.
    """
    least = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select(
        "doc_id", "lang", F.pmod(F.spark_partition_id(), F.lit(PARTS)).alias("part"))
    for group in (["lang", "part"], ["lang"]):
        order = W.partitionBy(*group).orderBy(F.xxhash64("doc_id"), "doc_id")
        least = least.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= sample).drop("_n")
    chosen = least.select("doc_id").distinct()
    texts = labelled.where("lang IS NOT NULL").select("doc_id", "lang", "text").join(chosen, "doc_id", "left_semi").select("lang", "text")

    def count(batches):
        for rows in portions(batches):
            names = sorted(set(rows["lang"]))
            owner, gram, n = grams_of(rows["text"])
            of = np.array([names.index(x) for x in rows["lang"]], np.int64)[owner]
            order = np.lexsort((gram, of))
            of, gram, n = of[order], gram[order], n[order]
            new = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (gram[1:] != gram[:-1])])) if len(of) else []
            if len(new):
                yield rows_batch(_GRAMS, [[names[i] for i in of[new]], gram[new], np.add.reduceat(n, new)])

    counted = texts.mapInArrow(lean(count), _GRAMS).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = W.partitionBy("lang").orderBy(F.desc("n"), "gram")
    profiles: dict[str, list[int]] = {}
    for r in (counted.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
              .orderBy("lang", "rank").collect()):
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


class Profiles:
    """Profiles as one sorted list of grams and a rank for each language."""

    def __init__(self, profiles: dict[str, list[int]], top: int = PROFILE):
        self.names, self.top = sorted(profiles), top
        self.grams = np.array(sorted({g for p in profiles.values() for g in p}), np.int64)
        self.rank = np.full((len(self.grams) + 1, len(self.names)), -1, np.int32)
        for k, name in enumerate(self.names):
            self.rank[np.searchsorted(self.grams, profiles[name]), k] = np.arange(len(profiles[name]))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score: one less the distance's share of the largest there could be."""
        owner, gram, rank = ranks_of(*grams_of(texts), self.top)
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not len(owner) or not self.names:
            return names, scores
        at = np.searchsorted(self.grams, gram)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != gram)] = len(self.grams)
        known = self.rank[at]
        cost = np.where(known >= 0, np.abs(known - rank[:, None]), self.top)
        start = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        total = np.add.reduceat(cost, start, axis=0)
        size = np.diff(np.append(start, len(owner)))
        best = total.argmin(axis=1)
        for i, b, t, n in zip(owner[start], best, total, size):
            names[i] = self.names[b]
            scores[i] = float(1 - t[b] / (n * self.top))
        return names, scores


def predict(docs: DataFrame, profiles: dict[str, list[int]], top: int = PROFILE, carry: list[str] = ()) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row, from the whole text alone.

    Null text, and text without a letter, is ``und`` with score 0, as is every
    text where nothing was learnt. A tie goes to the first language by name. Rows
    that repeat an id are judged each on their own; an empty table gives no rows.
    ``carry`` names columns of a row to hand on.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)  # languages times ``top`` numbers
    read, more = carried(docs, carry)

    def run(batches):
        model = Profiles(shared.value, top)
        for rows in portions(batches):
            yield rows_batch(_PREDICTED + more, [rows["doc_id"], *model.predict(rows["text"]), *[rows[c] for c in carry]])

    return docs.select(*read).mapInArrow(lean(run), _PREDICTED + more)
