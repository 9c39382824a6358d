"""Exact removal of long byte strings that an earlier document already has.

A column-wise construction sorts the suffixes of many short strings at once:
each round adds one symbol of every string, last symbols first, to a growing
Burrows-Wheeler transform and to the array of common prefixes with the suffix
before. Both live in files that a round reads and writes from front to back.

To bring equal strings together, every string of ``length`` bytes goes by its
anchor, the smallest hash of ``ANCHOR`` bytes in it: equal strings have equal
anchors. Neighbouring strings of one anchor are one short string (a read), so each
belongs to one read only. A string also has the bytes beside its anchor, half of what
is left of ``length`` on one side or the other; strings whose anchor with that side no
other document has are left out. So what chance brings together, which grows with the
square of the texts, goes no further. Equal reads are folded, reads of an anchor meet
in one collection, and there the runs of suffixes that have ``length`` bytes in common
give the first document of each string. An anchor with too many different reads for
one collection is spread over several; what they find is merged by string.

Between tasks, reads and verdicts on them go as packed columns, a row for each group of
documents and part of the anchors.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proxyspark.llm.common import cut, release, rows_batch

LENGTH = 50
ANCHOR = 16
#: Documents (bytes) whose anchors are gathered by one task, those of them hashed at
#: once, and bytes of reads in one collection.
GROUP_BYTES, HASHED_BYTES, COLLECTION_BYTES = 16 << 20, 1 << 18, 1 << 20
#: Text (bytes) for each part of the anchors.
PART_BYTES = 16 << 20
#: Different reads of one anchor that go to a single collection.
READS_TOGETHER = 4_000

_MANY = np.uint64(0x9E3779B97F4A7C15)
_KEYS = "bucket long, batch long, several boolean, keys binary"
_SHARED = "batch long, bucket long, keys binary"
_PACKED = "batch long, part long, anchors binary, reads binary, owners binary, lasts binary, sizes binary, data binary"
_READS = _PACKED + ", crowds binary, doc_ids binary, text_keys binary, docs binary, places binary"
_DEALT = _PACKED + ", hot boolean"
_SEGMENTS = "batch long, reads binary, starts binary, ends binary, firsts binary"
_SPREAD = "part long, to long, numbers binary, strings binary, string_firsts binary, batches binary, lasts binary"
_FOUND = f"{_SEGMENTS}, {_SPREAD}"
_KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text binary"


def anchor_hashes(data: np.ndarray, size: int = ANCHOR) -> np.ndarray:
    """A hash of the ``size`` bytes (a power of two) from every position, by doubling."""
    h = data.astype(np.uint64) + np.uint64(1)
    step, factor = 1, int(_MANY)
    while step < size:
        h = h[:-step] * np.uint64(factor) + h[step:]
        factor = factor * factor % (1 << 64)
        step *= 2
    h = h * _MANY
    return h ^ h >> np.uint64(29)


def _sliding(values: np.ndarray, span: int, of) -> np.ndarray:
    """``of`` over every ``span`` neighbours, by doubling."""
    width = 1
    while 2 * width <= span:
        values = of(values[:-width], values[width:])
        width *= 2
    rest = span - width
    return of(values[:-rest], values[rest:]) if rest else values


def reads_of(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray, length: int = LENGTH, size: int = ANCHOR) -> tuple:
    """``(text, begin, stop, anchor, split, left, right)`` of the reads of several texts
    of at least ``length`` bytes, which stand one behind the other in ``data``.

    All strings of a read hold its anchor at one place. Those from ``split`` on also hold
    the bytes behind it whose hash is ``right``, the ones before hold the bytes in front
    of it whose hash is ``left``.
    """
    h = anchor_hashes(data, size)
    least = _sliding(h, length - size + 1, np.minimum)
    # The smallest hash stays in place unless another value takes over or its place is left.
    changed = np.ones(len(least), bool)
    changed[1:] = (least[1:] != least[:-1]) | (h[:len(least) - 1] == least[:-1])
    changed[begins] = True
    begin = np.flatnonzero(changed)
    text = np.searchsorted(begins, begin, "right") - 1
    end = (begins + sizes - length)[text]
    last = np.minimum(np.append(begin[1:], len(least)) - 1, end)
    inside = begin <= end
    text, begin, last = text[inside], begin[inside], last[inside]
    anchor = least[begin]
    place, rest = last.copy(), np.arange(len(last))
    while len(rest):
        rest = rest[h[place[rest]] != anchor[rest]]
        place[rest] += 1
    half = (length - size) // 2
    split = np.clip(place - half, begin, last + 1)
    steps = [*range(0, half, size), half]

    def beside(at):
        out = np.zeros(len(at), np.uint64)
        for step in steps:
            out = (out + h[np.clip(at + step, 0, len(h) - 1)]) * _MANY
        return out ^ out >> np.uint64(31)

    return text, begin, last + length, anchor, split, beside(place - half), beside(place)


def collection_order(strings: list[bytes], folder: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of all strings in order: ``(string, offset, common)``, the last
    being the bytes in common with the suffix before, up to 255.

    Round j holds all suffixes of up to j bytes. A new suffix c + s goes where the
    symbol c that stands before s is mapped: behind all suffixes that start with a
    smaller symbol and behind as many that start with c as there are c before it.
    Its common prefix with the suffix before is one more than the least common
    prefix since the last c. Equal suffixes of different strings keep the order
    of the strings.
    """
    m = len(strings)
    sizes = np.array([len(s) for s in strings], np.int64)
    data = np.frombuffer(b"".join(strings), np.uint8)
    ends = np.cumsum(sizes)
    # Files stay open and only grow: to truncate one would have the disk flushed each round.
    bwts, lcps = ([open(os.path.join(folder, f"{kind}.{k}"), "w+b", buffering=0) for k in (0, 1)] for kind in ("bwt", "lcp"))

    def put(file, values):
        file.seek(0)
        file.write(values)

    def take(file, n):
        file.seek(0)
        return np.frombuffer(file.read(n), np.uint8)

    def symbols(active, done):
        """The symbol before the suffix of ``done`` bytes, and whether there is one."""
        more = sizes[active] > done
        out = np.zeros(len(active), np.uint8)
        out[more] = data[ends[active[more]] - done - 1]
        return out, more

    active = np.arange(m)
    bwt, live = symbols(active, 0)
    lcp = np.zeros(m, np.uint8)
    at, mark = np.arange(m), ~live  # mark: rows whose suffix is a whole string
    put(bwts[0], bwt), put(lcps[0], lcp)
    size = m
    active, at = active[live], at[live]
    done, turn = 0, 0
    while len(active):
        n = size
        bwt, lcp = take(bwts[turn], n), take(lcps[turn], n)
        rows = np.flatnonzero(~mark)
        order = rows[np.argsort(bwt[rows], kind="stable")]
        place = np.empty(n, np.int32)  # of a row's symbol among all, by symbol and row
        place[order] = np.arange(len(order), dtype=np.int32)
        new_at = m + place[at].astype(np.int64)
        # Least common prefix between a row and the row before with its symbol.
        symbol = bwt[order]
        same = np.concatenate([[False], symbol[1:] == symbol[:-1]])
        p = place[at]
        own = np.zeros(len(at), np.uint8)
        linked = same[p]
        own[linked] = _plus_one(_range_min(lcp, order[p[linked] - 1] + 1, at[linked] + 1))
        follower = np.minimum(p + 1, len(order) - 1)
        has_next = (p + 1 < len(order)) & same[follower]
        next_row = order[follower[has_next]]
        nexts = _plus_one(_range_min(lcp, at[has_next] + 1, next_row + 1))
        size = n + len(active)
        fresh = np.zeros(size, bool)
        fresh[new_at] = True
        grown = [np.empty(size, np.uint8) for _ in range(2)]
        grown_mark = np.zeros(size, bool)
        done += 1
        added, live = symbols(active, done)
        kept = ~fresh
        for old, new, values in ((bwt, grown[0], added), (lcp, grown[1], own), (mark, grown_mark, ~live)):
            new[kept] = old
            new[new_at] = values
        behind = new_at[has_next] + 1
        old_row = kept[behind]  # a new suffix behind has its own value already
        grown[1][behind[old_row]] = nexts[old_row]
        mark, turn = grown_mark, 1 - turn
        put(bwts[turn], grown[0]), put(lcps[turn], grown[1])
        active, at = active[live], new_at[live]
    bwt, lcp = take(bwts[turn], size), take(lcps[turn], size)
    for file in bwts + lcps:
        file.close()
    # Walk every string from its end: the map from a suffix to the one a symbol longer.
    rows = np.flatnonzero(~mark)
    order = rows[np.argsort(bwt[rows], kind="stable")]
    longer = np.full(len(bwt), -1, np.int64)
    longer[order] = m + np.arange(len(order))
    which, offset = np.empty(len(bwt), np.int64), np.empty(len(bwt), np.int64)
    row, string, left = np.arange(m), np.arange(m), sizes.copy()
    while len(row):
        which[row], offset[row] = string, left
        go = left > 0
        row, string, left = longer[row[go]], string[go], left[go] - 1
    return which, offset, lcp


def _plus_one(values: np.ndarray) -> np.ndarray:
    return np.where(values < 255, values + 1, 255).astype(np.uint8)


def _range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The smallest of ``values[lo:hi]`` for many non-empty ranges, by doubling."""
    out = np.zeros(len(lo), np.uint8)
    span = hi - lo
    level, width = values, 1
    rest = np.arange(len(lo))
    while len(rest):
        fits = span[rest] < 2 * width
        now = rest[fits]
        out[now] = np.minimum(level[lo[now]], level[hi[now] - width])
        rest = rest[~fits]
        if len(rest):
            level = np.minimum(level[:-width], level[width:])
            width *= 2
    return out


def first_owners(strings: list[bytes], owners: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """Per string and offset, the smallest owner of a string of this collection
    that holds the same ``length`` bytes."""
    with tempfile.TemporaryDirectory(prefix="bwt-") as folder:
        which, offset, common = collection_order(strings, folder)
    sizes = np.array([len(s) for s in strings], np.int64)
    enough = sizes[which] - offset >= length
    which, offset = which[enough], offset[enough]
    # Between two suffixes that are long enough, the shorter ones skipped may
    # only lower the common prefix, as they lie between them in order.
    least = _between(common, enough)
    run = np.cumsum(np.concatenate([[True], least[1:] < length])) - 1 if len(which) else np.zeros(0, np.int64)
    smallest = np.full(int(run[-1]) + 1 if len(run) else 0, np.iinfo(np.int64).max)
    np.minimum.at(smallest, run, owners[which])
    starts = np.concatenate([[0], np.cumsum(np.maximum(0, sizes - length + 1))])
    out = np.empty(starts[-1], np.int64)
    out[starts[which] + offset] = smallest[run]
    return [out[starts[i]:starts[i + 1]] for i in range(len(strings))]


def _between(common: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """For each chosen row the least common prefix since the chosen row before."""
    rows = np.flatnonzero(chosen)
    if not len(rows):
        return np.zeros(0, np.uint8)
    before = np.concatenate([[rows[0] - 1], rows[:-1]])
    return _range_min(common, before + 1, rows + 1)


def _split_hash(h: np.ndarray, buckets: int) -> np.ndarray:
    """A hash as its bucket, in the upper half, and 32 further bits."""
    return (h >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32) | h & np.uint64(0xFFFFFFFF)


def _texts(table: pa.Table, skip: set = frozenset()):
    """``(doc_ids, text_keys, data, begins, sizes)`` of the documents that ``skip``
    does not name, rows of one id and text once, so many together as make HASHED_BYTES."""
    ids, keys = table.column("doc_id").to_pylist(), table.column("text_key").to_pylist()
    texts, held, seen = [], 0, set(skip)

    def joined():
        sizes = np.array([len(t) for _, _, t in texts], np.int64)
        data = b"".join(t for _, _, t in texts)
        return (np.array([d for d, _, _ in texts], np.int64), np.array([k for _, k, _ in texts], np.int64),
                data, np.cumsum(sizes) - sizes, sizes)

    for d, k, t in zip(ids, keys, table.column("data")):
        if (d, k) not in seen:
            seen.add((d, k))
            texts.append((d, k, t.as_py()))
            held += len(texts[-1][2])
            if held >= HASHED_BYTES:
                yield joined()
                texts, held = [], 0
    if texts:
        yield joined()


def _groups(values: np.ndarray) -> list[tuple[int, int]]:
    """Where equal neighbours begin and end."""
    if not len(values):
        return []
    edges = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
    return list(zip(edges, edges[1:]))


def _spread(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each of ``begins`` on, so many as ``counts`` says, one list behind the other."""
    ends = np.cumsum(counts)
    return np.repeat(begins - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


def _joined(column, kind: str) -> np.ndarray:
    """The arrays that packed values hold, one behind the other; nulls hold nothing."""
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x is not None), kind)


def _table(ddl: str, rows: list) -> pa.Table:
    """Rows as a table."""
    return pa.Table.from_batches([rows_batch(ddl, list(zip(*rows)) or [[] for _ in ddl.split(", ")])])


def _by_batch(texts, side: DataFrame, run, ddl: str) -> DataFrame:
    """``run(documents, side)`` for each group of documents."""
    return texts.cogroup(side.groupBy("batch")).applyInArrow(
        lambda docs, side: run(docs, side) if docs.num_rows else _table(ddl, []), ddl)


def shared_reads(texts, later: DataFrame, batches: int, parts: int, length: int, size: int) -> DataFrame:
    """The reads that hold strings different documents may share, packed: a row for each
    group of documents and part of the anchors with its different reads, their smallest
    and largest document of the group, and the anchors that have several; and a row for
    each group (no part) with the places of its reads.

    ``texts`` are ``doc_id, text_key, data`` by group; ``later`` names those whose whole
    text an earlier document has, which add nothing. A group sends the hash of each of its
    different anchors, with the bytes beside it, once, so one that every document has
    arrives once per group.
    """
    skipped = later.withColumns({"bucket": F.lit(None).cast("long"), "keys": F.lit(None).cast("binary")})
    least = 1 if 2 * batches > READS_TOGETHER else 2  # below, an anchor's reads can't be too many for a collection

    def keys(docs: pa.Table, side: pa.Table) -> pa.Table:
        skip = set(zip(side.column("doc_id").to_pylist(), side.column("text_key").to_pylist()))
        hashes, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for ids, _, data, begins, sizes in _texts(docs, skip):
            text, begin, stop, _, split, left, right = reads_of(np.frombuffer(data, np.uint8), begins, sizes, length, size)
            for h, there in ((left, split > begin), (right, split + length <= stop)):
                hashes.append(_split_hash(h[there], parts))
                owners.append(ids[text[there]])
        h, owner = np.concatenate(hashes), np.concatenate(owners)
        order = np.argsort(h)
        h, owner = h[order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        several = np.minimum.reduceat(owner, first) < np.maximum.reduceat(owner, first) if len(h) else np.zeros(0, bool)
        h, batch, out = h[first], docs.column("batch")[0].as_py(), []
        for lo, hi in _groups(h >> np.uint64(32)):
            key = (h[lo:hi] & np.uint64(0xFFFFFFFF)).astype("<u4")
            for flag, chosen in ((False, ~several[lo:hi]), (True, several[lo:hi])):
                if chosen.any():
                    out.append((int(h[lo]) >> 32, batch, flag, key[chosen].tobytes()))
        return _table(_KEYS, out)

    def shared(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x, "<u4") for x in table.column("keys").to_pylist()]
        ends = np.cumsum([len(x) for x in keys])
        several = np.repeat(table.column("several").to_numpy(zero_copy_only=False), [len(x) for x in keys])
        key = np.concatenate(keys)
        order = np.argsort(key)
        ordered = key[order]
        again = np.zeros(len(key), bool)
        again[1:] = ordered[1:] == ordered[:-1]
        again[:-1] |= again[1:]
        good = several.copy()  # in one group of documents or in two
        good[order[again]] = True
        bucket, out = table.column("bucket")[0].as_py(), []
        for batch, x, end in zip(table.column("batch").to_pylist(), keys, ends.tolist()):
            wanted = x[good[end - len(x):end]]
            if len(wanted):
                out.append((batch, bucket, wanted.tobytes()))
        return _table(_SHARED, out)

    def reads(docs: pa.Table, side: pa.Table) -> pa.Table:
        skip, wanted = set(), [np.zeros(0, np.uint64)]
        for d, k, b, keys in zip(*(side.column(c).to_pylist() for c in ("doc_id", "text_key", "bucket", "keys"))):
            if keys is None:
                skip.add((d, k))
            else:
                wanted.append(np.uint64(b) << np.uint64(32) | np.frombuffer(keys, "<u4").astype(np.uint64))
        wanted, batch = np.sort(np.concatenate(wanted)), docs.column("batch")[0].as_py()

        def known(h):
            h = _split_hash(h, parts)
            order = np.argsort(h)  # to look up in order is quicker
            out = np.empty(len(h), bool)
            out[order] = wanted[np.minimum(np.searchsorted(wanted, h[order]), len(wanted) - 1)] == h[order]
            return out

        seen, which, anchors, all_ids, all_keys, docs_of, ats = {}, [], [], [], [], [], []
        n_docs = 0
        for ids, text_keys, data, begins, sizes in _texts(docs, skip) if len(wanted) else ():
            text, begin, stop, anchor, split, left, right = reads_of(np.frombuffer(data, np.uint8), begins, sizes, length, size)
            left, right = (split > begin) & known(left), (split + length <= stop) & known(right)
            begin, stop = np.where(left, begin, split), np.where(right, stop, split + length - 1)
            good = np.flatnonzero(left | right)
            text, begin, stop = text[good], begin[good], stop[good]
            number = len(seen)
            which += [seen.setdefault(data[a:b], len(seen)) for a, b in zip(begin.tolist(), stop.tolist())]
            new = np.array(which[len(which) - len(good):], np.int64)
            anchors.append(anchor[good][np.unique(new, return_index=True)[1][np.searchsorted(np.unique(new), number):]])
            all_ids.append(ids)
            all_keys.append(text_keys)
            docs_of.append(text + n_docs)
            ats.append(begin - begins[text])
            n_docs += len(ids)
        if not which:
            return _table(_READS, [])
        which, strings, anchor = np.array(which, np.int64), list(seen), np.concatenate(anchors)
        ids, doc = np.concatenate(all_ids), np.concatenate(docs_of)
        first, last = np.full(len(strings), np.iinfo(np.int64).max), np.full(len(strings), np.iinfo(np.int64).min)
        np.minimum.at(first, which, ids[doc])
        np.maximum.at(last, which, ids[doc])
        size_of = np.array([len(x) for x in strings], np.int64)
        part = (anchor >> np.uint64(20)) % np.uint64(parts)
        order, out = np.lexsort((anchor, part)), []
        for lo, hi in _groups(part[order]):
            own = order[lo:hi]
            new = np.flatnonzero(np.concatenate([[True], anchor[own[1:]] != anchor[own[:-1]]]))
            n = np.diff(np.append(new, hi - lo))
            crowds = np.stack([anchor[own[new]], n.astype(np.uint64)], 1)[n >= least]
            out.append((batch, int(part[own[0]]), anchor[own].astype("<u8").tobytes(), own.astype("<u4").tobytes(), first[own].astype("<i8").tobytes(),
                        last[own].astype("<i8").tobytes(), size_of[own].astype("<u4").tobytes(), b"".join(strings[i] for i in own.tolist()),
                        crowds.astype("<u8").tobytes() or None, *[None] * 4))
        out.append((batch, *[None] * 8, ids.astype("<i8").tobytes(), np.concatenate(all_keys).astype("<i8").tobytes(), doc.astype("<u4").tobytes(),
                    np.stack([which, np.concatenate(ats)]).astype("<u4").tobytes()))
        return _table(_READS, out)

    sent = _by_batch(texts, skipped, keys, _KEYS)
    found = cut(sent.groupBy("bucket").applyInArrow(shared, _SHARED), "anchors")
    release(later.sparkSession)
    return _by_batch(texts, skipped.unionByName(found, allowMissingColumns=True), reads, _READS)


def _recurring(strings: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Per string the offsets of the first and of the last ``length`` bytes in it whose
    hash comes twice or more in the collection; the last is below the first if none
    does. What lies outside equals nothing, so it need not be sorted."""
    sizes = np.array([len(s) for s in strings], np.int64)
    count = sizes - length + 1
    ends = np.cumsum(count)
    which = np.repeat(np.arange(len(strings)), count)
    offset = np.arange(ends[-1]) - (ends - count)[which]
    part = 1 << (length.bit_length() - 1)
    h = anchor_hashes(np.frombuffer(b"".join(strings), np.uint8), part)
    at = (np.cumsum(sizes) - sizes)[which] + offset
    h = h[at] * _MANY + h[at + length - part]
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    again = np.zeros(len(h), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    first, last = count.copy(), np.full(len(strings), -1)
    np.minimum.at(first, which[again], offset[again])
    np.maximum.at(last, which[again], offset[again])
    return first, last


def first_of_strings(strings: list[bytes], owners: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Per string and offset, one string behind the other, the smallest owner of a string
    of this collection that holds the same ``length`` bytes; and how many offsets each has.

    What is left of strings without the ends that nothing equals is often alike: it is
    folded and looked at again, and sorted when all of it differs.
    """
    count = np.array([len(s) for s in strings], np.int64) - length + 1
    firsts, starts = np.repeat(owners, count), np.cumsum(count) - count
    lo, hi = _recurring(strings, length)
    go = np.flatnonzero(lo <= hi)
    if not len(go):
        return firsts, count
    folded = {}
    which = np.array([folded.setdefault(strings[i][a:b + length], len(folded)) for i, a, b in zip(go.tolist(), lo[go].tolist(), hi[go].tolist())])
    least = np.full(len(folded), np.iinfo(np.int64).max)
    np.minimum.at(least, which, owners[go])
    if len(folded) < len(go):
        found, sizes = first_of_strings(list(folded), least, length)
    else:
        found = np.concatenate(first_owners(list(folded), least, length))
        sizes = (hi - lo + 1)[go]
    own = (hi - lo + 1)[go]
    firsts[_spread((starts + lo)[go], own)] = found[_spread((np.cumsum(sizes) - sizes)[which], own)]
    return firsts, count


def first_of_each(reads: DataFrame, batches: int, parts: int, length: int) -> DataFrame:
    """Verdicts for each group of documents, packed: numbers of its reads, where in them
    equal verdicts start and end, and the smallest document that has the ``length`` bytes
    from each of these offsets. Only of strings that some document need not keep."""
    spark = reads.sparkSession
    spare = 0 if 2 * batches > READS_TOGETHER else batches  # an anchor with one read in a group is not counted there

    def crowded(table: pa.Table) -> pa.Table:
        anchor, n = _joined(table.column("crowds"), "<u8").reshape(-1, 2).T
        distinct, inverse = np.unique(anchor, return_inverse=True)
        many = distinct[np.bincount(inverse, n) + spare > READS_TOGETHER]
        return _table("part long, many binary", [(table.column("part")[0].as_py(), many.tobytes())] if len(many) else [])

    def deal(batches_):
        names = [c.split()[0] for c in _PACKED.split(", ")][2:]
        for piece in batches_:
            out = []
            for row in piece.to_pylist():
                if row["many"] is None:
                    out.append((*(row[c] for c in ("batch", "part", *names)), False))
                    continue
                anchors, reads_, owners, lasts, sizes = (np.frombuffer(row[c], k) for c, k in zip(names, ("<u8", "<u4", "<i8", "<i8", "<u4")))
                ends = np.cumsum(sizes.astype(np.int64))
                hot = np.isin(anchors, np.frombuffer(row["many"], "<u8"))
                strings = [row["data"][e - n:e] for e, n in zip(ends.tolist(), sizes.tolist())]
                target = np.full(len(anchors), -1)
                target[hot] = [zlib.crc32(strings[i]) % parts for i in np.flatnonzero(hot).tolist()]
                order = np.argsort(target, kind="stable")
                for lo, hi in _groups(target[order]):
                    own = order[lo:hi]
                    to = int(target[own[0]])
                    out.append((row["batch"], row["part"] if to < 0 else to, *(c[own].tobytes() for c in (anchors, reads_, owners, lasts, sizes)),
                                b"".join(strings[i] for i in own.tolist()), to >= 0))
            yield from _table(_DEALT, out).to_batches()

    def by_batch(segments: list) -> list:
        """Packed rows of ``batch, read, start, end, first``."""
        out = []
        if segments:
            batch, *columns = (np.concatenate(c) for c in zip(*segments))
            order = np.argsort(batch, kind="stable")
            for lo, hi in _groups(batch[order]):
                own = order[lo:hi]
                out.append((int(batch[own[0]]), *(c[own].astype(k).tobytes() for c, k in zip(columns, ("<u4", "<u4", "<u4", "<i8")))))
        return out

    def sort(table: pa.Table) -> pa.Table:
        hots, segments, out = table.column("hot").to_numpy(zero_copy_only=False), [], []
        strings_of, least, held = {}, [], []  # of anchors that are spread
        for hot in (False, True):
            some = table.filter(pa.array(hots == hot))
            if not some.num_rows:
                continue
            anchors, numbers, owners, lasts, sizes = (_joined(some.column(c), k) for c, k in (
                ("anchors", "<u8"), ("reads", "<u4"), ("owners", "<i8"), ("lasts", "<i8"), ("sizes", "<u4")))
            batch = np.repeat(some.column("batch").to_numpy(), [len(x) // 8 for x in some.column("anchors").to_pylist()])
            data = b"".join(some.column("data").to_pylist())
            ends = np.cumsum(sizes.astype(np.int64))
            # Equal reads meet, and of an anchor that is not spread all reads.
            spread = np.array([zlib.crc32(data[e - n:e]) // parts for e, n in zip(ends.tolist(), sizes.tolist())], np.uint64) if hot else anchors >> np.uint64(42)
            collection = spread % np.uint64(max(1, -(-len(data) // COLLECTION_BYTES)))
            order = np.argsort(collection, kind="stable")
            for lo, hi in _groups(collection[order]):
                own = order[lo:hi]
                folded = {}
                which = np.array([folded.setdefault(data[e - n:e], len(folded)) for e, n in zip(ends[own].tolist(), sizes[own].tolist())])
                strings = list(folded)
                owner, last = np.full(len(strings), np.iinfo(np.int64).max), np.full(len(strings), np.iinfo(np.int64).min)
                np.minimum.at(owner, which, owners[own])
                np.maximum.at(last, which, lasts[own])
                firsts, count = first_of_strings(strings, owner, length)
                starts = np.cumsum(count) - count
                if hot:  # other collections may hold an equal string
                    number = np.array([strings_of.setdefault(x[k:k + length], len(strings_of)) for x in strings for k in range(len(x) - length + 1)])
                    least.append((number, firsts))
                    n = count[which]
                    held.append((number[_spread(starts[which], n)], np.repeat(batch[own], n), np.repeat(numbers[own], n),
                                 _spread(np.zeros(len(n), np.int64), n), np.repeat(lasts[own], n)))
                    continue
                edge = np.ones(len(firsts), bool)
                edge[1:] = firsts[1:] != firsts[:-1]
                edge[starts] = True
                begin = np.flatnonzero(edge)
                end = np.append(begin[1:], len(firsts))
                of = np.searchsorted(starts, begin, "right") - 1
                needed = firsts[begin] < last[of]
                begin, end, of = begin[needed], end[needed], of[needed]
                n = np.bincount(of, minlength=len(strings))
                seg = _spread((np.cumsum(n) - n)[which], n[which])
                read = np.repeat(own, n[which])
                needed = firsts[begin[seg]] < lasts[read]
                seg, read = seg[needed], read[needed]
                segments.append((batch[read], numbers[read], (begin - starts[of])[seg], (end - starts[of])[seg], firsts[begin[seg]]))
        out = [(*row, *[None] * 7) for row in by_batch(segments)]
        if held:
            number, batch, read, start, last = (np.concatenate(c) for c in zip(*held))
            own_part, strings, firsts = table.column("part")[0].as_py(), list(strings_of), np.full(len(strings_of), np.iinfo(np.int64).max)
            for which, first in least:
                np.minimum.at(firsts, which, first)
            out.append((None, read.astype("<u4").tobytes(), start.astype("<u4").tobytes(), None, firsts.astype("<i8").tobytes(), own_part, None,
                        number.astype("<u4").tobytes(), None, None, batch.astype("<i8").tobytes(), last.astype("<i8").tobytes()))
            target = np.array([zlib.crc32(x) % parts for x in strings])
            order = np.argsort(target, kind="stable")
            for lo, hi in _groups(target[order]):
                own = order[lo:hi]
                out.append((*[None] * 5, own_part, int(target[own[0]]), own.astype("<u4").tobytes(), b"".join(strings[i] for i in own.tolist()),
                            firsts[own].astype("<i8").tobytes(), None, None))
        return _table(_FOUND, out)

    def merge(table: pa.Table) -> pa.Table:
        """Strings of several parts: the smallest first document, sent to those that know a larger one."""
        numbers, firsts = _joined(table.column("numbers"), "<u4"), _joined(table.column("string_firsts"), "<i8")
        part = np.repeat(table.column("part").to_numpy(), [len(x) // 4 for x in table.column("numbers").to_pylist()])
        data, seen = b"".join(table.column("strings").to_pylist()), {}
        which = np.array([seen.setdefault(data[k:k + length], len(seen)) for k in range(0, len(data), length)])
        least = np.full(len(seen), np.iinfo(np.int64).max)
        np.minimum.at(least, which, firsts)
        least = least[which]
        order, out = np.argsort(part, kind="stable"), []
        for lo, hi in _groups(part[order]):
            own = order[lo:hi]
            own = own[least[own] < firsts[own]]
            if len(own):
                out.append((int(part[order[lo]]), numbers[own].astype("<u4").tobytes(), least[own].astype("<i8").tobytes()))
        return _table("part long, numbers binary, string_firsts binary", out)

    def settle(held: pa.Table, merged: pa.Table) -> pa.Table:
        if not held.num_rows:
            return _table(_SEGMENTS, [])
        read, start, number, firsts, batch, last = (_joined(held.column(c), k) for c, k in (
            ("reads", "<u4"), ("starts", "<u4"), ("numbers", "<u4"), ("firsts", "<i8"), ("batches", "<i8"), ("lasts", "<i8")))
        firsts = firsts.copy()
        firsts[_joined(merged.column("numbers"), "<u4")] = _joined(merged.column("string_firsts"), "<i8")
        first = firsts[number]
        go = first < last
        return _table(_SEGMENTS, by_batch([(batch[go], read[go], start[go], start[go] + 1, first[go])] if go.any() else []))

    packed = reads.where("part IS NOT NULL").select(*[c.split()[0] for c in _PACKED.split(", ")])
    hot = cut(reads.where("crowds IS NOT NULL").select("part", "crowds").groupBy("part").applyInArrow(crowded, "part long, many binary"), "hot-anchors")
    if hot.isEmpty():
        dealt = packed.withColumn("hot", F.lit(False))
    else:  # one anchor for thousands of reads at most
        dealt = packed.join(F.broadcast(hot), "part", "left").select(*packed.columns, "many").mapInArrow(deal, _DEALT)
    found = cut(dealt.groupBy("part").applyInArrow(sort, _FOUND), "firsts", "zstd")
    release(spark)
    names = [c.split()[0] for c in _SEGMENTS.split(", ")]
    cold = found.where("batch IS NOT NULL").select(*names)
    # Reads of an anchor that was spread: a string that several parts have is merged, once for each.
    merged = found.where("to IS NOT NULL").select("part", "to", "numbers", "strings", "string_firsts").groupBy("to").applyInArrow(
        merge, "part long, numbers binary, string_firsts binary")
    held = found.where("batches IS NOT NULL").select("part", "reads", "starts", "firsts", "numbers", "batches", "lasts")
    return cold.unionByName(held.groupBy("part").cogroup(merged.groupBy("part")).applyInArrow(settle, _SEGMENTS))


def remove_repeats(docs: DataFrame, length: int = LENGTH, size: int = ANCHOR) -> DataFrame:
    """Every row's text without the bytes of any ``length``-byte string that a
    document of a smaller ``doc_id`` has: ``doc_id, n_bytes, n_removed, n_spans,
    kept_sha256, kept_text``.

    Strings are judged on the input and never cross documents. Null text counts
    as empty. Rows that share an id are not earlier than one another. A row
    without an id keeps its text and takes none from others. Extra columns are
    ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("data"))
    is_judged = F.col("doc_id").isNotNull() & (F.octet_length("data") >= length)
    judged = cut(rows.where(is_judged).select("doc_id", F.xxhash64("data").alias("text_key"), F.sha2("data", 256).alias("digest"),
                                              F.octet_length("data").alias("n")), "facts")
    total = judged.agg(F.sum("n")).first()[0] or 0
    batches, parts = max(1, -(-total // GROUP_BYTES)), max(1, total // PART_BYTES)
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).alias("batch")
    first = judged.groupBy("digest").agg(F.min("doc_id").alias("first"))
    later = cut(judged.join(first, "digest").where("doc_id > first").select(batch, "doc_id", "text_key").distinct(), "later")
    texts = rows.where(is_judged).select(batch, "doc_id", F.xxhash64("data").alias("text_key"), "data").groupBy("batch")
    reads = cut(shared_reads(texts, later, batches, parts, length, size), "reads", "zstd")
    release(spark)
    places = reads.where("part IS NULL").select("batch", "doc_ids", "text_keys", "docs", "places")
    side = later.unionByName(places, allowMissingColumns=True).unionByName(
        first_of_each(reads, batches, parts, length), allowMissingColumns=True)

    def keep(docs: pa.Table, side: pa.Table) -> pa.Table:
        whole = set(zip(side.column("doc_id").to_pylist(), side.column("text_key").to_pylist()))
        ids, keys, doc = (_joined(side.column(c), k) for c, k in (("doc_ids", "<i8"), ("text_keys", "<i8"), ("docs", "<u4")))
        which, at = _joined(side.column("places"), "<u4").reshape(2, -1).astype(np.int64)
        read, start, end, first = (_joined(side.column(c), k) for c, k in (("reads", "<u4"), ("starts", "<u4"), ("ends", "<u4"), ("firsts", "<i8")))
        order = np.argsort(read, kind="stable")
        lo, hi = (np.searchsorted(read[order], which, s) for s in ("left", "right"))
        place, seg = np.repeat(np.arange(len(which)), hi - lo), order[_spread(lo, hi - lo)]
        earlier = first[seg] < ids[doc[place]]
        place, seg = place[earlier], seg[earlier]
        span_doc, span_start, span_end = doc[place], at[place] + start[seg], at[place] + end[seg] + length - 1
        order = np.argsort(span_doc, kind="stable")
        span_doc, span_start, span_end = span_doc[order], span_start[order], span_end[order]
        number = {x: i for i, x in enumerate(zip(ids.tolist(), keys.tolist()))}
        copies = {}
        for x in zip(docs.column("doc_id").to_pylist(), docs.column("text_key").to_pylist()):
            copies[x] = copies.get(x, 0) + 1
        out = []
        for ids, keys, data, begins, sizes in _texts(docs):
            named = list(zip(ids.tolist(), keys.tolist()))
            change = np.zeros(len(data) + 1, np.int32)
            numbers = np.array([number.get(x, -1) for x in named])
            lo, hi = (np.searchsorted(span_doc, numbers, s) for s in ("left", "right"))
            own, begin = _spread(lo, hi - lo), np.repeat(begins, hi - lo)
            np.add.at(change, begin + span_start[own], 1)
            np.add.at(change, begin + span_end[own], -1)
            gone = np.cumsum(change[:-1]) > 0
            for i, x in enumerate(named):
                if x in whole:
                    gone[begins[i]:begins[i] + sizes[i]] = True
            entered = gone.copy()
            entered[1:] &= ~gone[:-1]
            entered[begins] = gone[begins]
            removed, spans = np.add.reduceat(gone, begins, dtype=np.int64), np.add.reduceat(entered, begins, dtype=np.int64)
            kept, ends = np.frombuffer(data, np.uint8)[~gone].tobytes(), np.cumsum(sizes - removed)
            for x, n, r, s, e in zip(named, sizes.tolist(), removed.tolist(), spans.tolist(), ends.tolist()):
                text = kept[e - n + r:e]
                out += [(x[0], n, r, s, hashlib.sha256(text).hexdigest(), text)] * copies[x]
        return _table(_KEPT, out)

    short = rows.where(~F.coalesce(is_judged, F.lit(False))).select(
        "doc_id", F.octet_length("data").cast("long").alias("n_bytes"), *(F.lit(0).cast("long").alias(c) for c in ("n_removed", "n_spans")),
        F.sha2("data", 256).alias("kept_sha256"), F.col("data").alias("kept_text"))
    return _by_batch(texts, side, keep, _KEPT).unionByName(short)
