"""A Merkle manifest of a dataset, its nodes stored in van Emde Boas order.

Leaves of a group (a source) form a tree whose nodes have up to ``FAN`` children.
The tree is cut into aligned subtrees of ``HEIGHT`` levels; each is a block, one row
with all its nodes in a single byte string. Inside a block the nodes lie in van Emde
Boas order: the subtree is split at half its height into a top and its bottoms, each
stored whole and split again. A node's place follows by arithmetic from level and
index alone, for building as for finding siblings, and neither needs to know how much
of a block a reader fetches at once. The roots of a group's blocks are the leaves of
its next tier, which is cut into blocks again, until a group has one block. The
groups' roots form one more such tree.

No task holds more than a block; a group of any size is as many blocks. Leaves are
ranked in their group by one range sort of small rows: texts are never shuffled.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proxyspark.llm.common import cut, kept, rows_batch

FAN = 3
#: Levels of nodes above a block's leaves: 729 leaves, 1093 nodes of 32 bytes.
HEIGHT = 6
CAPACITY = FAN ** HEIGHT
_DIGEST = 32

_BLOCK = "grp string, block long, total long, levels int, n_leaves int, nodes binary, root binary"
_PATH = "grp string, slot long, path binary, subroot binary"
_PROVED = "doc_id long, leaf binary, subroot binary, root binary, proof_sha256 string, folded binary"


class Manifest(NamedTuple):
    """Written tables. ``leaves``: doc_id, grp, pos, leaf, other; ``tiers`` and ``top``:
    the blocks of each tier, lowest first, of the groups' trees and of the tree over
    them; ``groups``: grp, subroot, place."""
    leaves: DataFrame
    tiers: list[DataFrame]
    groups: DataFrame
    top: list[DataFrame]


# --- the layout ----------------------------------------------------------------------

def tree_size(levels: int) -> int:
    """Nodes of a full tree of so many levels of nodes."""
    return (FAN ** levels - 1) // (FAN - 1)


def place(levels: int, depth: int, index):
    """Where the node ``index`` at ``depth`` (the root's is 0) lies in a tree of
    ``levels`` levels of nodes; ``index`` may be an array."""
    if levels == 1:
        return index * 0
    top = levels // 2
    if depth < top:
        return place(top, depth, index)
    below = levels - top
    number, inside = index // FAN ** (depth - top), index % FAN ** (depth - top)
    return tree_size(top) + number * tree_size(below) + place(below, depth - top, inside)


def _places(levels: int) -> list[list[int]]:
    """Byte offsets of all nodes of a block, a list per depth."""
    return kept(("merkle", levels), lambda: [
        (place(levels, d, np.arange(FAN ** d)) * _DIGEST).tolist() for d in range(levels)])


def _levels(leaves: int) -> int:
    """Levels of nodes, the leaves' own included, until one node is left."""
    levels = 1
    while FAN ** (levels - 1) < leaves:
        levels += 1
    return levels


def parent(children: list[bytes]) -> bytes:
    """Hash of the children's digests as lower-case hex text."""
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def build_block(leaves: list[bytes], levels: int) -> bytes:
    """All nodes over ``leaves``; where a block is not full, places stay zero."""
    places = _places(levels)
    nodes = bytearray(tree_size(levels) * _DIGEST)
    row = leaves
    for depth in range(levels - 1, -1, -1):
        for at, digest in zip(places[depth], row):
            nodes[at:at + _DIGEST] = digest
        row = [parent(row[i:i + FAN]) for i in range(0, len(row), FAN)]
    return bytes(nodes)


def siblings(nodes: bytes, levels: int, n_leaves: int, leaf: int) -> list[tuple[int, list[bytes]]]:
    """Per level from the leaf up: its place in its run, and the run's other nodes."""
    places, out, count, at = _places(levels), [], n_leaves, leaf
    for depth in range(levels - 1, 0, -1):
        first = at - at % FAN
        run = [nodes[p:p + _DIGEST] for p in places[depth][first:min(first + FAN, count)]]
        own = at - first
        out.append((own, run[:own] + run[own + 1:]))
        at, count = at // FAN, -(-count // FAN)
    return out


def pack_path(steps: list[tuple[int, list[bytes]]]) -> bytes:
    """Per level a byte for the place, a byte for the number of siblings, and these."""
    return b"".join(bytes((own, len(others))) + b"".join(others) for own, others in steps)


def read_path(path: bytes) -> list[tuple[int, list[bytes]]]:
    out, at = [], 0
    while at < len(path):
        own, n = path[at], path[at + 1]
        at += 2
        out.append((own, [path[at + i * _DIGEST:at + (i + 1) * _DIGEST] for i in range(n)]))
        at += n * _DIGEST
    return out


def fold(leaf: bytes, steps: list[tuple[int, list[bytes]]]) -> bytes:
    """The root that a leaf and its siblings give."""
    for own, others in steps:
        leaf = parent(others[:own] + [leaf] + others[own:])
    return leaf


# --- ranking ---------------------------------------------------------------------------

def in_place(rows: DataFrame, order: list, name: str) -> DataFrame:
    """Adds ``pos``, the rank of a row in its ``grp`` by ``order``, and ``total``, the
    group's size. One range sort; counts per sorted partition and group give the rest.

    Rows that are alike in all of ``order`` may fall into several partitions.
    """
    spread = F.monotonically_increasing_id()
    by = ["grp", *order]
    ordered = rows.withColumn("_spread", spread).repartitionByRange(*by, "_spread").sortWithinPartitions(*by, "_spread").drop("_spread")
    placed = cut(ordered.withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33).alias("_part")
    counts = placed.groupBy(part, "grp").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy("grp")
    before = F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = cut(counts.select(
        F.col("_part"), "grp", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(group).alias("total")), name + "_starts")
    return placed.withColumn("_part", part).join(starts, ["_part", "grp"]).withColumn(
        "pos", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


# --- building --------------------------------------------------------------------------

def _build(table: pa.Table) -> pa.Table:
    rows = sorted(zip(table["pos"].to_pylist(), table["leaf"].to_pylist()))
    grp, total, block = (table[c][0].as_py() for c in ("grp", "total", "block"))
    levels = _levels(total) if total <= CAPACITY else HEIGHT + 1
    nodes = build_block([leaf for _, leaf in rows], levels)
    # The root is always the first node.
    return pa.Table.from_batches([rows_batch(_BLOCK, [[v] for v in (
        grp, block, total, levels, len(rows), nodes, nodes[:_DIGEST])])])


def _build_tiers(nodes: DataFrame, name: str) -> list[DataFrame]:
    """``nodes`` (grp, pos, total, leaf) as blocks, tier after tier; the number of
    tiers is the logarithm of the largest group."""
    largest, tiers = nodes.agg(F.max("total")).first()[0], []
    while largest:
        numbered = nodes.select("grp", "pos", "total", "leaf", F.floor(F.col("pos") / CAPACITY).alias("block"))
        tiers.append(cut(numbered.groupBy("grp", "block").applyInArrow(_build, _BLOCK), f"{name}_{len(tiers)}"))
        if largest <= CAPACITY:
            break
        largest = -(-largest // CAPACITY)
        nodes = tiers[-1].where(F.col("total") > CAPACITY).select(
            "grp", F.col("block").alias("pos"), F.ceil(F.col("total") / CAPACITY).alias("total"), F.col("root").alias("leaf"))
    return tiers


def field(value: Column) -> Column:
    """A value as the leaf hash takes it: its UTF-8 byte count, a colon, itself; ``-`` if NULL."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(columns: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(c) for c in columns]).cast("binary"), 256))


def manifest(rows: DataFrame, group: Column, order: str, columns: list[Column], other: Column) -> Manifest | None:
    """Builds the trees over ``rows``: a leaf each of ``columns``, by ``group`` (text)
    and ascending ``order`` (NULL first, ties by leaf hash). ``other`` is a second
    digest to keep beside the leaf. None for no rows."""
    # An empty name for no group sorts before all names, and joins like any other.
    grp = F.coalesce(F.concat(F.lit("="), group), F.lit(""))
    digests = cut(rows.select(F.col(order).cast("long").alias("doc_id"), grp.alias("grp"), leaf_hash(columns).alias("leaf"),
                              other.alias("other")), "digests")
    placed = cut(in_place(digests, [F.col("doc_id").asc_nulls_first(), "leaf"], "sorted"), "leaves")
    tiers = _build_tiers(placed, "tier")
    if not tiers:
        return None
    done = [t.where(F.col("total") <= CAPACITY).select("grp", F.col("root").alias("subroot")) for t in tiers]
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    named = found.select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("subroot").alias("leaf"))
    groups = cut(in_place(named, ["name"], "groups_sorted"), "groups")
    top = _build_tiers(groups, "top")
    return Manifest(placed, tiers, groups.select(F.col("name").alias("grp"), F.col("leaf").alias("subroot"), F.col("pos").alias("place")), top)


# --- proofs -----------------------------------------------------------------------------

def _hand_down(table: pa.Table) -> pa.Table:
    """The path from each leaf of a block to the root of everything."""
    block = table.to_pylist()[0]
    n, first = block["n_leaves"], block["block"] * CAPACITY
    paths = [pack_path(siblings(block["nodes"], block["levels"], n, i)) + block["path"] for i in range(n)]
    return pa.Table.from_batches([rows_batch(_PATH, [
        [block["grp"]] * n, list(range(first, first + n)), paths, [block["subroot"]] * n])])


def _leaf_paths(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("grp", "block").applyInArrow(_hand_down, _PATH)


def _lowest_blocks(tiers: list[DataFrame], above: DataFrame | None, name: str) -> DataFrame:
    """The blocks of the lowest tier with the path from their root and their subroot.

    A group's last block takes what ``above`` (grp, path, subroot) says of the group,
    nothing where its root is the root of everything; any other is a leaf one tier up and takes the path from there.
    """
    down = None
    for t in range(len(tiers) - 1, -1, -1):
        blocks = tiers[t].where(F.col("total") <= CAPACITY)
        blocks = blocks.withColumns({"path": F.lit(b""), "subroot": F.lit(b"")}) if above is None else blocks.join(above, "grp")
        if down is not None:
            inner = tiers[t].where(F.col("total") > CAPACITY).join(down.withColumnRenamed("slot", "block"), ["grp", "block"])
            blocks = blocks.unionByName(inner)
        if t:
            down = cut(_leaf_paths(blocks), f"{name}_{t}")
    return blocks


def _prove(leaves: pa.Table, blocks: pa.Table) -> pa.Table:
    block = blocks.to_pylist()[0]
    above = read_path(block["path"])
    nodes, levels, n = block["nodes"], block["levels"], block["n_leaves"]
    first = block["block"] * CAPACITY
    tail = "".join(s.hex() for _, others in above for s in others).encode()
    proofs, folded = [], []
    for pos, other in zip(leaves["pos"].to_pylist(), leaves["other"].to_pylist()):
        steps = siblings(nodes, levels, n, pos - first)
        proofs.append(hashlib.sha256("".join(s.hex() for _, others in steps for s in others).encode() + tail).hexdigest())
        folded.append(fold(fold(other, steps), above))
    rows = leaves.num_rows
    return pa.Table.from_batches([rows_batch(_PROVED, [
        leaves["doc_id"].to_pylist(), leaves["leaf"].to_pylist(), [block["subroot"]] * rows, [fold(block["root"], above)] * rows,
        proofs, folded])])


def prove(found: Manifest) -> DataFrame:
    """A row per leaf: doc_id, leaf, subroot, the root that its block leads to, the
    hash of its proof, and ``folded``, the root that ``other`` in its place gives."""
    over = cut(_leaf_paths(_lowest_blocks(found.top, None, "top_paths")), "group_paths")
    above = found.groups.join(over.select(F.col("slot").alias("place"), "path"), "place").select("grp", "path", "subroot")
    blocks = _lowest_blocks(found.tiers, above, "paths")
    leaves = found.leaves.withColumn("block", F.floor(F.col("pos") / CAPACITY))
    return leaves.groupBy("grp", "block").cogroup(blocks.groupBy("grp", "block")).applyInArrow(_prove, _PROVED)


def verify(docs: DataFrame) -> DataFrame:
    """Leaf, roots and proof of every document, checked with texts tampered with.

    A leaf covers doc_id, source, lang, n_chars and text; other columns are ignored.
    Where 2 divides crc32 of the id as text, the leaf that is folded upwards has the
    text without its line feeds; a row without an id is not tampered with. Returns
    doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. Rows of one id
    keep a leaf each, in the order of leaf hashes; NULL and empty texts and sources are
    told apart; a NULL source is a group of its own, before all others. Empty tables
    give no rows.
    """
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    even = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    plain = [F.col(c) for c in columns]
    changed = plain[:-1] + [F.when(F.coalesce(even, F.lit(False)), F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))]
    found = manifest(docs, F.col("source"), "doc_id", plain, leaf_hash(changed))
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
                                                     "folded_root string, verified boolean")
    text = lambda c: F.lower(F.hex(c))
    return prove(found).select(
        "doc_id", text("leaf").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"), "proof_sha256",
        text("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))
