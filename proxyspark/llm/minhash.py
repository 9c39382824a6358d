"""MinHash near-duplicates: documents, links, components.

Every distinct text gets the minima of many universal hashes over its set of
word shingles. Bands of minima put it into buckets; members of a bucket are
candidates, which agree on enough minima to be worth a look and are then
confirmed on their full sets. Components come from alternating large-star and
small-star steps.

Copies of a text are folded onto one representative first. Members of a bucket
are compared with its smallest one, and what that links is contracted. Buckets
whose members then still carry several labels are looked at once more in blocks
of bounded size (``residual_links``): a block compares the minima of its members
as arrays and confirms pairs that are likely links between two labels, each in
the first band that the two share.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proxyspark.llm.common import as_bytes, cut, lean, rows_batch

#: At 80 % similarity a pair misses all bands with a chance of (1 - 0.8^6)^42 = 3e-6.
BANDS, ROWS = 42, 6
#: Pairs at 80 % similarity agree on 202 of 252 minima, give or take 6.3; fewer
#: than this are more than four deviations off.
AGREE = 176
SHINGLE, PERCENT = 4, 80
#: Members of a bucket that are compared in one block, on average.
BLOCK = 512

_SKETCH = "doc_id long, digest binary, n_shingles long, keys binary, marks binary"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PAIR = "a long, b long"
_WHITE = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))  # A-Z to a-z


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space."""
    return (text or b"").translate(_WHITE).split()


class _WordHashes(dict):
    """64-bit hashes of words as bytes; emptied when it holds ``limit`` words."""

    limit = 200_000

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        found = self[word] = hashlib.blake2b(word, digest_size=8).digest()
        return found


def shingles(words: list[bytes], known: dict[bytes, bytes], size: int = SHINGLE) -> np.ndarray:
    """The distinct ``size``-word shingles as 64-bit hashes, sorted; the whole
    sequence where it is shorter, nothing without words."""
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.frombuffer(b"".join([known[w] for w in words]), "<u8")
    n = max(1, len(words) - size + 1)
    mixed = np.full(n, min(len(words), size), np.uint64)
    for k in range(min(size, len(words))):
        mixed = (mixed ^ codes[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The fixed odd ``a`` and ``b`` of ``n`` universal hashes."""
    random = np.random.default_rng(20_240_101)
    return random.integers(0, 1 << 63, n, np.uint64) << np.uint64(1) | np.uint64(1), random.integers(0, 1 << 63, n, np.uint64)


def minima(found: np.ndarray, a: np.ndarray, b: np.ndarray, block: int = 256) -> np.ndarray:
    """The minimum over the shingles of each multiply-shift hash, the upper half
    of ``a x + b`` in 64 bits."""
    best = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    room = np.empty((len(a), min(block, len(found))), np.uint64)
    for lo in range(0, len(found), block):
        x = found[lo:lo + block]
        values = room[:, :len(x)]
        np.multiply(a[:, None], x, out=values)
        values += b[:, None]
        np.minimum(best, values.min(axis=1), out=best)
    return (best >> np.uint64(32)).astype("<u4")


def summary(found: np.ndarray, a: np.ndarray, b: np.ndarray, rows: int) -> tuple[bytes, bytes]:
    """A set's band keys, 64 bits for each ``rows`` minima, and the lowest byte of
    every minimum, by which two sets are compared."""
    low = minima(found, a, b)
    keys = np.zeros(len(low) // rows, np.uint64)
    for column in low.reshape(-1, rows).T:
        keys = (keys ^ column) * _MIX
        keys ^= keys >> np.uint64(32)
    return keys.astype("<u8").tobytes(), low.astype(np.uint8).tobytes()


def sketches(docs: DataFrame, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row: digest of its words, size of its shingle set, its band keys and
    the marks of its minima (null where the set is empty)."""

    def run(batches):
        a, b = coefficients(bands * rows)
        known = _WordHashes()
        for batch in batches:
            done: dict[bytes, tuple] = {}
            out = []
            for text in as_bytes(batch.column(1)):
                words = words_of(text)
                digest = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
                if digest not in done:
                    found = shingles(words, known, size)
                    done[digest] = (digest, len(found), *(summary(found, a, b, rows) if len(found) else (None, None)))
                out.append(done[digest])
            if out:
                yield rows_batch(_SKETCH, [batch.column(0), *zip(*out)])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), _SKETCH)


def band_rows(nodes: DataFrame, bands: int) -> DataFrame:
    """``bucket, band, id`` for every band of every node."""
    keys = F.array(*[F.xxhash64(F.lit(k), F.substring("keys", 1 + 8 * k, 8)) for k in range(bands)])
    return nodes.select("id", F.posexplode(keys).alias("band", "bucket")).select("bucket", "band", "id")


def confirmed(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, size: int, percent: int, agree: int) -> DataFrame:
    """The pairs whose minima agree often enough and whose full sets are similar enough."""

    def alike(batches):
        for batch in batches:
            left = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, -1) if batch.num_rows else None
            if left is not None:
                right = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                good = (left == right).sum(axis=1) >= agree
                yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good))

    def similar(batches):
        known = _WordHashes()
        last, last_set = None, None
        for batch in batches:
            ids, good = batch.column(0).to_pylist(), []
            for a, left, right in zip(ids, as_bytes(batch.column(2)), as_bytes(batch.column(3))):
                if a != last:
                    last, last_set = a, shingles(words_of(left), known, size)
                good.append(similar_sets(last_set, shingles(words_of(right), known, size), percent))
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    def side(of, name, value):
        return of.select(F.col("id").alias(name), F.col(value).alias(f"{value}_{name}"))

    likely = (pairs.join(side(nodes, "a", "marks"), "a").join(side(nodes, "b", "marks"), "b")
              .select("a", "b", "marks_a", "marks_b").mapInArrow(lean(alike), _PAIR))
    likely = cut(likely.distinct(), "likely")
    return (likely.join(side(texts, "b", "text"), "b").join(side(texts, "a", "text"), "a")
            .select("a", "b", "text_a", "text_b").mapInArrow(lean(similar), _PAIR).distinct())


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` (the smallest id) of every end of ``edges`` (``a, b``).

    Alternates large-star (every larger neighbour is linked to the smallest one)
    and small-star (the same among the smaller ones) until nothing changes.
    """

    def star(links: DataFrame, large: bool) -> DataFrame:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b"), F.col("a")))
        if not large:  # only neighbours that are not larger than u
            both = both.where("v < u")
        least = both.groupBy("u").agg(F.min("v").alias("least")).withColumn("least", F.least("u", "least"))
        joined = both.join(least, "u")
        if large:
            out = joined.where("v > u").select(F.col("least").alias("a"), F.col("v").alias("b"))
        else:
            out = (joined.where("v != least").select(F.col("least").alias("a"), F.col("v").alias("b"))
                   .union(least.select(F.col("least"), F.col("u"))))
        return out.where("a != b").distinct()

    def mark(links: DataFrame):
        # Ids may lie near either end of 64 bits: their sums do not fit.
        whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
        r = links.agg(F.count("*").alias("n"), whole("a"), whole("b"),
                      F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        return r["n"], r["a"], r["b"], r["x"]

    links = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct(), "links")
    before, now = None, mark(links)
    while now != before:
        links = cut(star(star(links, True), False), "links")
        before, now = now, mark(links)
    return links.select(F.col("b").alias("id"), F.col("a").alias("component")).union(
        links.select("a", "a").distinct())


def labelled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, label`` of all nodes: their component, or themselves."""
    return nodes.select("id").distinct().join(components(edges), "id", "left").select(
        "id", F.coalesce("component", "id").alias("label"))


def similar_sets(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def likely_pairs(rows: list[tuple], lo: int, hi: int, agree: int) -> list[tuple[int, int]]:
    """Pairs of one block that differ in label and agree often enough, if this is
    the first band whose key they share. ``rows`` are ``(id, label, block, band,
    marks, keys)``; where ``lo`` and ``hi`` differ, one side of a pair is of either block."""
    ids, labels, blocks = (np.array([r[k] for r in rows], np.int64) for k in range(3))
    marks = np.frombuffer(b"".join([r[4] for r in rows]), np.uint8).reshape(len(rows), -1)
    keys = np.frombuffer(b"".join([r[5] for r in rows]), "<u8").reshape(len(rows), -1)[:, :rows[0][3]]
    out = []
    for i in range(len(rows) - 1) if lo == hi else np.flatnonzero(blocks == lo):
        others = np.arange(i + 1, len(rows)) if lo == hi else np.flatnonzero(blocks == hi)
        others = others[labels[others] != labels[i]]
        others = others[(marks[others] == marks[i]).sum(axis=1) >= agree]
        if not len(others):
            continue
        earlier = (keys[others] == keys[i]).any(axis=1)
        out += [(min(ids[i], x), max(ids[i], x)) for x in ids[others[~earlier]]]
    return out


_MET = "bucket long, lo int, hi int, id long, label long, block int, band int, marks binary, keys binary"


def _groups(batches):
    """Runs of rows with the same first three columns, which the rows come sorted by."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:3] != key:
                if len(rows) > 1:
                    yield rows
                key, rows = row[:3], []
            rows.append(row)
    if len(rows) > 1:
        yield rows


def residual_links(buckets: DataFrame, labels: DataFrame, nodes: DataFrame, texts: DataFrame, size: int, percent: int,
                   agree: int, width: int, block: int = BLOCK) -> DataFrame:
    """``a, b``: links between members of a bucket that carry different labels.

    A bucket of more than ``block`` members is cut into blocks by a hash of the
    id, and every two blocks meet in a group of their own, so no task holds a
    whole bucket. A group first finds, by their marks, the members that have a
    likely partner; these get their texts, and the same group then confirms its
    likely pairs on full sets. There is never a row per pair that is no link.
    Where ``nodes`` have no ``keys``, a pair is looked at in every bucket it shares.
    ``width``, the minima of a band, decides nothing any more.
    """
    keys = F.col("keys") if "keys" in nodes.columns else F.lit(b"")
    named = buckets.join(labels, "id")
    mixed = (named.groupBy("bucket").agg(F.count("*").alias("n"), F.min("label").alias("x"), F.max("label").alias("y"))
             .where("x != y").select("bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    live = named.join(mixed, "bucket").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = live.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("bucket", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
                     "id", "label", "block", "band").join(nodes.select("id", "marks", keys.alias("keys")), "id")
    names = [c.split()[0] for c in _MET.split(", ")]

    def grouped(rows, *more):
        return rows.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "id").select(*names, *more)

    def partnered(batches):
        found = []
        for rows in _groups(batches):
            ids = {i for pair in likely_pairs([r[3:] for r in rows], rows[0][1], rows[0][2], agree) for i in pair}
            found += [r for r in rows if r[3] in ids]
            if len(found) > 5_000:
                yield rows_batch(_MET, list(zip(*found)))
                found = []
        yield rows_batch(_MET, list(zip(*found)) or [[] for _ in names])

    def links(batches):
        known = _WordHashes()
        for rows in _groups(batches):
            sets, found = {}, []
            for r in rows:
                sets.setdefault(r[3], []).append(shingles(words_of(r[9]), known, size))
            for a, b in likely_pairs([r[3:9] for r in rows], rows[0][1], rows[0][2], agree):
                if any(similar_sets(x, y, percent) for x in sets[a] for y in sets[b]):
                    found.append((a, b))
            if found:
                yield rows_batch(_PAIR, list(zip(*found)))

    likely = cut(grouped(met).mapInArrow(lean(partnered), _MET), "partnered")
    told = likely.join(texts.select("id", F.col("text").cast("binary").alias("text")), "id")
    return grouped(told, "text").mapInArrow(lean(links), _PAIR).distinct()


def link(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS,
         agree: int = AGREE) -> DataFrame:
    """Near-duplicate components of ``docs``: ``doc_id, n_shingles, component_id,
    kept``, a row per row.

    Two documents are linked if their sets of ``size``-word shingles have at least
    ``percent`` percent in common; a component's id is its smallest ``doc_id``.
    Null or empty text has an empty set and is linked with nothing. Rows that
    share an id are one document, linked with whatever one of its texts is; a
    null id has no component and is not kept. Extra columns are ignored.
    """
    found = cut(sketches(docs, size, bands, rows), "sketches")
    full = found.where("n_shingles > 0 AND doc_id IS NOT NULL")
    copies = full.groupBy("digest").agg(F.min("doc_id").alias("id"))
    members = full.select("doc_id", "digest").join(copies, "digest").select("doc_id", "id").distinct()
    nodes = cut(full.join(copies, "digest").where("doc_id = id").select("id", "digest", "keys", "marks").distinct(), "nodes")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))

    buckets = band_rows(nodes, bands).distinct()
    centre = buckets.groupBy("bucket").agg(F.min("id").alias("c"), F.count("*").alias("n")).where("n > 1")
    buckets = cut(buckets.join(centre.select("bucket", "c"), "bucket"), "buckets")
    pairs = buckets.where("id != c").select(F.col("c").alias("a"), F.col("id").alias("b")).distinct()
    # Several texts of one id: its representatives belong together.
    several = members.groupBy("doc_id").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1")
    several = several.select("doc_id", "a").join(members, "doc_id").select("a", F.col("id").alias("b")).where("a != b")
    edges = cut(confirmed(pairs, nodes, texts, size, percent, agree).union(several), "edges")
    labels = cut(labelled(nodes, edges), "labels")
    more = residual_links(buckets.drop("c"), labels, nodes, texts, size, percent, agree, rows)
    edges = edges.union(cut(more, "edges"))
    whole = (members.join(labelled(nodes, edges), "id")
             .groupBy("doc_id").agg(F.min("label").alias("component_id")))
    return (found.select("doc_id", "n_shingles").join(whole, "doc_id", "left")
            .withColumn("component_id", F.coalesce("component_id", "doc_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))))
