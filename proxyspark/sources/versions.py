"""Replacement that nobody sees half done: versioned folders and one pointer.

Every job writes its rows into folders of a version of its own, below
``<table>/version=V``. Which version holds an upload is said by the pointer, a small
table of (upload_id, bucket, version) written whole as a new generation and made valid
by a marker file. A generation's number is claimed by a file that is created only if it
is not there, so of two jobs that start from one state a single one commits. Readers
take the newest generation with a marker: they see an upload's old rows or its new ones
in all tables at once, and nothing of a job that died.

No row of a stored folder is ever rewritten. Where an upload goes and others share its
folders (a version's part of one hash bucket), the others' rows are copied into the
version that replaces it and their pointers move in the same commit; then the folders
that no pointer names are deleted whole. A job that dies before its commit leaves
folders no reader looks at, one that dies after it leaves folders that the next
replacement of the upload, or ``sweep``, deletes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proxyspark.sources import tables

VERSIONED = ("entries", "entry_rollups", "status_rollups", "latency_sketches", "uploads")
_POINTER = "upload_id string, bucket int, version string"
#: Generations kept besides the newest, for readers that began before it.
KEPT = 1


def new_version(run: str) -> str:
    """A version name that no attempt has used before."""
    return f"{run}-{uuid.uuid4().hex[:12]}"


def _key(kind: str) -> str:
    return "id" if kind == "uploads" else "upload_id"


def write_version(df: DataFrame, root: str, kind: str, version: str, buckets: int = tables.BUCKETS) -> None:
    """Append rows to a version; the table layout lies below the version's folder."""
    tables.write_table(df.drop("version", "month", "bucket"), f"{root}/{kind}/version={version}", kind, buckets)


def read_version(spark: SparkSession, root: str, kind: str, version: str) -> DataFrame | None:
    """One version's rows, listed from its own folder."""
    return tables.read_if_present(spark, f"{root}/{kind}/version={version}")


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm.getFileSystem(spark._jsc.hadoopConfiguration()), jvm


def _generations(spark: SparkSession, root: str) -> tuple[dict[int, str], int]:
    """Committed generations with their folders, and the highest number claimed."""
    fs, path = _fs(spark, f"{root}/commits")
    if not fs.exists(path):
        return {}, 0
    done, claimed = {}, 0
    for folder in fs.listStatus(path):
        number = int(folder.getPath().getName().split("=")[1])
        names = [f.getPath().getName() for f in fs.listStatus(folder.getPath())]
        claimed = max(claimed, number if "_claim" in names else 0)
        done |= {number: f"{root}/commits/generation={number}/{n.removeprefix('_committed-')}" for n in names if n.startswith("_committed-")}
    return done, claimed


def _newest(spark: SparkSession, root: str) -> int:
    return max(_generations(spark, root)[0], default=0)


def pointer(spark: SparkSession, root: str) -> DataFrame | None:
    """(upload_id, bucket, version) of the newest generation, or None without any."""
    done, _ = _generations(spark, root)
    return spark.read.schema(_POINTER).parquet(done[max(done)]) if done else None


def _commit(spark: SparkSession, root: str, rows: DataFrame, base: int) -> None:
    """Make ``rows`` the pointer if ``base`` is still the newest generation."""
    done, claimed = _generations(spark, root)
    number, name = claimed + 1, f"data-{uuid.uuid4().hex}"
    folder = f"{root}/commits/generation={number}"
    rows.write.parquet(f"{folder}/{name}")
    fs, claim = _fs(spark, f"{folder}/_claim")
    if _newest(spark, root) != base or not fs.createNewFile(claim):
        raise RuntimeError(f"another job changed {root} meanwhile; run this one again")
    fs.createNewFile(_fs(spark, f"{folder}/_committed-{name}")[1])
    for old in sorted(done)[:-KEPT]:
        fs.delete(_fs(spark, f"{root}/commits/generation={old}")[1], True)


def read_committed(spark: SparkSession, root: str, kind: str, uploads: DataFrame | None = None) -> DataFrame | None:
    """The rows of a table that the pointer names; None where the table is absent.

    ``uploads`` (upload_id) narrows it to some uploads before folders are picked: their
    few (bucket, version) pairs become a filter on folders.
    """
    stored, named = tables.read_if_present(spark, f"{root}/{kind}"), pointer(spark, root)
    if stored is None or named is None:
        return stored
    if uploads is not None:
        named = named.join(uploads.select("upload_id").distinct(), "upload_id", "left_semi")
        stored = _in_folders(stored, _pairs(named))
    key = _key(kind)
    wanted = named.select(F.col("upload_id").alias(key), F.col("version").alias("version"))
    return stored.withColumn("version", F.col("version").cast("string")).join(wanted, [key, "version"], "left_semi")


def _pairs(rows: DataFrame) -> list[tuple]:
    """Folder pairs (bucket, version): bounded by buckets and versions, not by rows."""
    return sorted((r[0], r[1]) for r in rows.select("bucket", F.col("version").cast("string")).distinct().collect())


def _in_folders(df: DataFrame, pairs: list[tuple]) -> DataFrame:
    """Literal tests on the two folder columns, so that only these are read."""
    if not pairs:
        return df.where(F.lit(False))
    return df.where(F.col("version").isin(sorted({v for _, v in pairs})) & F.col("bucket").isin(sorted({b for b, _ in pairs})))


def publish(spark: SparkSession, root: str, ids: DataFrame, version: str, buckets: int = tables.BUCKETS) -> None:
    """Make a written version the one that holds ``ids`` (upload_id)."""
    _switch(spark, root, ids.select("upload_id").distinct(), version, buckets, True)


def count_rows(spark: SparkSession, root: str, ids: DataFrame) -> list[tuple]:
    """(table, stored rows) of some uploads in the versioned tables."""
    manifest = tables.read_if_present(spark, f"{root}/uploads")
    pairs = _pairs(manifest.join(ids.select(F.col("upload_id").alias("id")), "id", "left_semi"))
    out = []
    for kind in VERSIONED:
        stored = tables.read_if_present(spark, f"{root}/{kind}")
        keys = ids.select(F.col("upload_id").alias(_key(kind)))
        out.append((kind, 0 if stored is None else _in_folders(stored, pairs).join(keys, _key(kind), "left_semi").count()))
    return out


def retire(spark: SparkSession, root: str, ids: DataFrame, buckets: int | None = None) -> None:
    """Take ``ids`` (upload_id) out of every versioned table. Without ``buckets``, the
    number the tables are written with, the whole manifest is searched for them."""
    _switch(spark, root, ids.select("upload_id").distinct(), new_version("kept"), buckets, False)


def _switch(spark: SparkSession, root: str, ids: DataFrame, version: str, buckets: int | None, added: bool) -> None:
    empty = spark.createDataFrame([], _POINTER)
    base, old = _newest(spark, root), pointer(spark, root)
    old = empty if old is None else old
    pairs = _places(spark, root, ids, buckets, version)
    stay = old.join(ids, "upload_id", "left_anti")
    beside = _exactly(stay, pairs)
    if pairs and not beside.isEmpty():
        for kind in VERSIONED:
            _copy(spark, root, kind, pairs, beside, version)
        stay = stay.join(beside.select("upload_id"), "upload_id", "left_anti").unionByName(beside.withColumn("version", F.lit(version)))
    if added:
        stay = stay.unionByName(ids.select("upload_id", tables._bucket("upload_id", buckets).alias("bucket"), F.lit(version).alias("version")))
    _commit(spark, root, stay, base)
    alive = set(_pairs(pointer(spark, root)))
    _drop_folders(spark, root, [p for p in pairs if p not in alive])


def _places(spark: SparkSession, root: str, ids: DataFrame, buckets: int | None, version: str) -> list[tuple]:
    """Folder pairs where the manifest has rows of ``ids``, named by a pointer or not."""
    manifest = tables.read_if_present(spark, f"{root}/uploads")
    if manifest is None:
        return []
    if buckets is not None:
        near = [r[0] for r in ids.select(tables._bucket("upload_id", buckets)).distinct().collect()]
        manifest = manifest.where(F.col("bucket").isin(near))
    found = _pairs(manifest.join(ids.withColumnRenamed("upload_id", "id"), "id", "left_semi"))
    return [p for p in found if p[1] != version]


def _copy(spark: SparkSession, root: str, kind: str, pairs: list[tuple], uploads: DataFrame, version: str) -> None:
    """The rows of ``uploads`` in some folders, into another version."""
    stored = tables.read_if_present(spark, f"{root}/{kind}")
    if stored is None:
        return
    rows = _in_folders(stored, pairs).withColumn("version", F.col("version").cast("string"))
    wanted = uploads.select(F.col("upload_id").alias(_key(kind)), "version")
    tables._write(rows.join(wanted, [_key(kind), "version"], "left_semi").drop("version"), f"{root}/{kind}/version={version}", kind, "append")


def _exactly(rows: DataFrame, pairs: list[tuple]) -> DataFrame:
    """Pointer rows whose folder pair is among ``pairs``."""
    if not pairs:
        return rows.where(F.lit(False))
    return rows.where(F.struct("bucket", "version").isin([F.struct(F.lit(b), F.lit(v)) for b, v in pairs]))


def _drop_folders(spark: SparkSession, root: str, pairs: list[tuple]) -> None:
    """Delete a version's part of a bucket in every table, the manifest's last."""
    for kind in VERSIONED:
        for bucket, version in pairs:
            base = f"{root}/{kind}/version={version}"
            fs, _ = _fs(spark, base)
            for pattern in (f"{base}/bucket={bucket}", f"{base}/*/bucket={bucket}"):
                for found in fs.globStatus(_fs(spark, pattern)[1]) or []:
                    fs.delete(found.getPath(), True)


def sweep(spark: SparkSession, root: str) -> list[str]:
    """Delete versions that no pointer names, as jobs that died leave them; which they
    were. Only while no other job writes: a version not committed yet looks the same."""
    named = pointer(spark, root)
    alive = set() if named is None else {v for _, v in _pairs(named)}
    gone = set()
    for kind in VERSIONED:
        fs, path = _fs(spark, f"{root}/{kind}")
        for status in (fs.listStatus(path) if fs.exists(path) else []):
            name = status.getPath().getName()
            if name.startswith("version=") and name.split("=", 1)[1] not in alive:
                fs.delete(status.getPath(), True)
                gone.add(name.split("=", 1)[1])
    return sorted(gone)
