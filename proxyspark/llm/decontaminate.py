"""Benchmark decontamination with an FM-index per shard of the training text.

A shard is a bounded run of documents as word numbers. Its suffixes are sorted
by prefix doubling, its Burrows-Wheeler transform goes into a wavelet matrix,
and every 16th text position keeps its suffix number. Test windows are searched
backwards, all at once, by ranks in the wavelet matrix; what is found is located
by walking back to a sampled position, and the hits of a document are merged
into removal spans.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proxyspark.llm.common import as_bytes, carried, lean, rows_batch

WINDOW = 10
#: Words of a shard; a longer document is cut into overlapping parts.
SHARD_WORDS = 1_000_000
#: Pairs of window and item that are sent to the tasks as one block.
BLOCK_PAIRS = 200_000
SAMPLED = 16

_FOUND = ("doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
          "span_start array<long>, span_end array<long>, items string")
_WINDOWS = "item string, words string"
# Lower-case ASCII letters, digits and every byte of a non-ASCII character are
# word bytes; the others part words.
_WORD_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORD_BYTES).split()


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffix array of word numbers, the last of which is the only smallest one.

    Prefix doubling: suffixes ranked by h words are ranked by 2h through the rank
    h words on. Only suffixes that still share their rank go on to the next round.
    """
    n = len(text)
    bits = max(1, int(n).bit_length())
    if 3 * bits > 63:
        raise ValueError("the shard is too long for one sort key")
    counts = np.bincount(text)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    rank = first[text]
    active = np.flatnonzero(counts[text] > 1)
    step = 1
    while len(active):
        after = rank[np.minimum(active + step, n - 1)]
        key = np.sort((rank[active] << bits | after) << bits | active)
        pair = key >> bits
        place = key & ((1 << bits) - 1)
        new_pair = np.concatenate([[True], pair[1:] != pair[:-1]])
        group = pair >> bits
        new_group = np.concatenate([[True], group[1:] != group[:-1]])
        index = np.arange(len(key))
        group_start = np.maximum.accumulate(np.where(new_group, index, 0))
        pair_start = np.maximum.accumulate(np.where(new_pair, index, 0))
        rank[place] = group + (pair_start - group_start)
        alone = new_pair & np.concatenate([new_pair[1:], [True]])
        active = place[~alone]
        step *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order


class Bits:
    """A bit string with rank: set bits before a position."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[:len(packed)] = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1) != 0


class Wavelet:
    """A wavelet matrix: a level of bits per binary digit of a symbol, highest first."""

    def __init__(self, symbols: np.ndarray, largest: int):
        self.levels = []
        rest = symbols.astype(np.uint32)
        for shift in range(max(1, int(largest).bit_length()) - 1, -1, -1):
            one = (rest >> np.uint32(shift) & np.uint32(1)).astype(bool)
            bits = Bits(one)
            self.levels.append((shift, bits, len(rest) - int(bits.before[-1])))
            rest = np.concatenate([rest[~one], rest[one]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each ``symbol`` before each position ``at``."""
        lo = np.zeros(len(at), np.int64)
        hi = at.copy()
        for shift, bits, zeros in self.levels:
            one = (symbol >> shift & 1).astype(bool)
            a, b = bits.rank(lo), bits.rank(hi)
            lo = np.where(one, zeros + a, lo - a)
            hi = np.where(one, zeros + b, hi - b)
        return hi - lo

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and how often it occurs before it."""
        symbol = np.zeros(len(at), np.int64)
        lo, hi = np.zeros(len(at), np.int64), at.copy()
        for _, bits, zeros in self.levels:
            one = bits.get(hi)
            a, b = bits.rank(lo), bits.rank(hi)
            symbol = symbol << 1 | one
            lo = np.where(one, zeros + a, lo - a)
            hi = np.where(one, zeros + b, hi - b)
        return symbol, hi - lo


class FMIndex:
    """Search in a text of word numbers from 1; the index adds the end symbol 0."""

    def __init__(self, text: np.ndarray, largest: int):
        text = np.concatenate([text, [0]]).astype(np.int64)
        order = suffix_order(text)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=largest + 1))])
        self.wavelet = Wavelet(text[order - 1], largest)
        sampled = order % SAMPLED == 0
        self.sampled, self.samples = Bits(sampled), order[sampled]
        self.n = len(text)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows ``[lo, hi)`` of suffixes that start with each pattern; patterns
        are rows of word numbers, right-aligned, of which the last ``length`` count."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), self.n, np.int64)
        alive = np.arange(len(patterns))
        width = patterns.shape[1]
        for k in range(width):
            alive = alive[(lengths[alive] > k) & (lo[alive] < hi[alive])]
            if not len(alive):
                break
            symbol = patterns[alive, width - 1 - k]
            lo[alive] = self.first[symbol] + self.wavelet.rank(symbol, lo[alive])
            hi[alive] = self.first[symbol] + self.wavelet.rank(symbol, hi[alive])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each row's suffix."""
        found, steps = np.full(len(rows), -1, np.int64), np.zeros(len(rows), np.int64)
        open_rows, at = np.arange(len(rows)), rows.astype(np.int64)
        while len(open_rows):
            hit = self.sampled.get(at)
            found[open_rows[hit]] = self.samples[self.sampled.rank(at[hit])] + steps[open_rows[hit]]
            open_rows, at = open_rows[~hit], at[~hit]
            symbol, before = self.wavelet.access(at)
            at = self.first[symbol] + before
            steps[open_rows] += 1
        return found


def windows_of(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct ``item, words``: the windows of every item, words joined by a space.

    An item of fewer words is one window; one without words, without text or
    without an id has none. Repeated items count once.
    """

    def run(batches):
        for batch in batches:
            items, found = [], []
            for item, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                words = words_of(text)
                for k in range(max(1, len(words) - window + 1) if words else 0):
                    items.append(item)
                    found.append(b" ".join(words[k:k + window]).decode())
            yield rows_batch(_WINDOWS, [items, found])

    return (benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
            .where("item_id IS NOT NULL").mapInArrow(run, _WINDOWS).distinct())


def _block(pairs, window: int) -> dict:
    """Windows of one block as arrays: distinct words, each window's word numbers
    (right-aligned), its length, and its items."""
    vocabulary, windows, items, of_window, of_item = {}, {}, {}, [], []
    for item, words in pairs:
        of_window.append(windows.setdefault(words, len(windows)))
        of_item.append(items.setdefault(item, len(items)))
    numbers = np.zeros((len(windows), window), np.int32)
    lengths = np.zeros(len(windows), np.int32)
    for text, k in windows.items():
        ids = [vocabulary.setdefault(w, len(vocabulary)) for w in text.encode().split(b" ")]
        numbers[k, window - len(ids):], lengths[k] = ids, len(ids)
    order = np.argsort(of_window, kind="stable")
    return {"words": list(vocabulary), "windows": numbers, "lengths": lengths, "items": list(items),
            "pair_item": np.array(of_item, np.int64)[order],
            "pair_from": np.searchsorted(np.array(of_window, np.int64)[order], np.arange(len(windows) + 1))}


def _search_shard(parts: list[np.ndarray], vocabulary: dict[bytes, int], blocks) -> tuple[list, list]:
    """Per part of the shard: hit spans ``(start, end)`` in words, and item names."""
    largest = len(vocabulary) + 1
    text = np.concatenate([x for part in parts for x in (part, [largest])])  # a symbol between parts
    starts = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
    index = FMIndex(text, largest)
    spans, items = [[] for _ in parts], [set() for _ in parts]
    for shared in blocks:
        block = shared.value
        number = np.array([vocabulary.get(w, 0) for w in block["words"]], np.int64)
        inside = np.arange(block["windows"].shape[1]) >= block["windows"].shape[1] - block["lengths"][:, None]
        mapped = np.where(inside, number[block["windows"]], -1)
        possible = np.flatnonzero((mapped != 0).all(axis=1))
        lo, hi = index.search(mapped[possible], block["lengths"][possible])
        count = np.maximum(hi - lo, 0)
        which = np.repeat(possible, count)
        rows = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at = index.locate(rows)
        part = np.searchsorted(starts, at, "right") - 1
        begin = at - starts[part]
        for p in np.unique(part):
            mine = part == p
            length = block["lengths"][which[mine]]
            spans[p].append(np.stack([begin[mine], begin[mine] + length], axis=1))
            for w in np.unique(which[mine]):
                items[p].update(block["items"][i] for i in
                                block["pair_item"][block["pair_from"][w]:block["pair_from"][w + 1]])
        if len(blocks) > 1:
            shared.__dict__.pop("_value", None)  # one block in memory at a time
    return spans, items


def merged(spans: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans as ascending, disjoint, non-touching ``start, end``."""
    if not spans:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    all_spans = np.concatenate(spans)
    all_spans = all_spans[np.lexsort((all_spans[:, 1], all_spans[:, 0]))]
    reach = np.maximum.accumulate(all_spans[:, 1])
    new = np.concatenate([[True], all_spans[1:, 0] > reach[:-1]])
    return all_spans[new, 0], reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS,
         carry: list[str] = ()) -> DataFrame:
    """Hits of benchmark windows in every row's whole text.

    ``n_hit`` words lie in an occurrence of a window; ``items`` are the ids of
    items with one, as strings in order, and ``span_start``/``span_end`` the
    merged removal spans in words. Null text has no words. Rows that repeat an
    id are searched each on their own; extra columns are ignored, but for those that
    ``carry`` names, which a row hands on.

    The windows go to the tasks in blocks of about ``BLOCK_PAIRS`` pairs, so
    neither the driver nor a task holds more than one block at a time; all blocks are
    broadcast, so their sum must fit beside a task, as a benchmark's does.
    """
    spark = docs.sparkSession
    read, more = carried(docs, carry)
    pairs = windows_of(benchmark, window).persist()
    n_blocks = max(1, -(-pairs.count() // BLOCK_PAIRS))
    numbered = pairs.withColumn("_block", F.pmod(F.xxhash64("words", "item"), F.lit(n_blocks)))
    blocks = [
        spark.sparkContext.broadcast(_block(sorted(map(tuple, numbered.where(F.col("_block") == b).drop("_block").collect())), window))
        for b in range(n_blocks)]
    pairs.unpersist()

    def rows_of(group, vocabulary):
        spans, items = _search_shard([ids for _, _, ids in group], vocabulary, blocks)
        for (row, offset, _), s, i in zip(group, spans, items):
            row["spans"] += [x + offset for x in s]
            row["items"] |= i

    def emit(rows):
        out = [[] for _ in range(9)]
        for row in rows:
            start, end = merged(row["spans"])
            names = ",".join(sorted(row["items"]))
            hit = int((end - start).sum())
            for column, v in zip(out, [row["doc_id"], row["n"], hit, len(row["items"]),
                                       hashlib.sha256(names.encode()).hexdigest(), hit > 0, start, end, names]):
                column.append(v)
        return rows_batch(_FOUND + more, out + [[row["carried"][c] for row in rows] for c in carry])

    def run(batches):
        rows, group, vocabulary, size = [], [], {}, 0
        for batch in batches:
            handed_on = batch.select(list(carry)).to_pylist() if carry else [None] * batch.num_rows
            for doc_id, text, more_of in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), handed_on):
                words = words_of(text)
                row = {"doc_id": doc_id, "n": len(words), "spans": [], "items": set(), "carried": more_of}
                rows.append(row)
                for lo in range(0, len(words), shard_words - window + 1):
                    part = words[lo:lo + shard_words]
                    if size and size + len(part) > shard_words:
                        rows_of(group, vocabulary)
                        group, vocabulary, size = [], {}, 0
                    ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in part]
                    group.append((row, lo, np.array(ids, np.int64)))
                    size += len(part)
                    if lo + shard_words >= len(words):
                        break
                if not group or group[0][0] is row:  # every row before this one is done
                    if len(rows) > 1 and group:
                        yield emit(rows[:-1])
                        rows = rows[-1:]
                    elif not group and len(rows) >= 10_000:
                        yield emit(rows)
                        rows = []
        if group:
            rows_of(group, vocabulary)
        if rows:
            yield emit(rows)

    return docs.select(*read).mapInArrow(lean(run), _FOUND + more)
