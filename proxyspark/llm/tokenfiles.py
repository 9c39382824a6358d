"""Token-ID files: flat unsigned integers plus 64-bit document offsets.

Layout of a folder, one set of files per partition of ascending ``doc_id``:

- ``part-NNNNN.ids``: the partition's ids, little-endian, ``width`` bytes each;
- ``part-NNNNN.off``: n + 1 unsigned 64-bit offsets into it, in ids;
- ``part-NNNNN.doc``: n signed 64-bit document ids (the smallest value: null);
- ``manifest/``: a table of parts with ``base``, the ids of all parts before,
  which is a prefix sum over the parts' counts.

A part is written under a name of its attempt and then renamed, so a retried
task leaves one whole part. Files are reached through ``pyarrow.fs``; local
ones are memory-mapped.
"""

from __future__ import annotations

import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proxyspark.llm.common import rows_batch, shared_folder
from proxyspark.llm.tokens import encoder

NO_DOC = -(1 << 63)
_PART = "part long, n_docs long, n_tokens long, width int"
_DOC = "doc_id long, start long, n_tokens long, ids_crc32 long"


def filesystem(uri: str):
    """The file system of a folder and the folder's path on it; memory-mapped if local."""
    found, path = pafs.FileSystem.from_uri(uri)
    return (pafs.LocalFileSystem(use_mmap=True) if isinstance(found, pafs.LocalFileSystem) else found), path


class WholeFile:
    """A file that appears under its name only when it is complete."""

    def __init__(self, fs, path: str):
        self.fs, self.path, self.attempt = fs, path, f"{path}.{uuid.uuid4().hex}"
        self.out = fs.open_output_stream(self.attempt, compression=None)

    def write(self, data) -> None:
        self.out.write(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.attempt, self.path)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """Encode every whole text, ``end_id`` after each, in ascending ``doc_id``
    order, into ``folder``; returns the manifest.

    Null text counts as empty (one id: the end). Rows that share a ``doc_id``
    keep a place each, ordered by text; a null ``doc_id`` comes first. Extra
    columns are ignored. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
               .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text"))

    def write(batches):
        enc = encoder(tokenizer)
        end = end_id.to_bytes(enc.width, "little")
        part, files, offsets, ids = TaskContext.get().partitionId(), None, array("Q", [0]), array("q")
        for batch in batches:
            if batch.num_rows and files is None:
                fs, path = filesystem(folder)
                fs.create_dir(path, recursive=True)
                files = {k: WholeFile(fs, f"{path}/part-{part:05d}.{k}") for k in ("ids", "off", "doc")}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = enc.encode(text.as_py()) + end
                files["ids"].write(data)
                offsets.append(offsets[-1] + len(data) // enc.width)
                ids.append(NO_DOC if doc_id is None else doc_id)
        if files is not None:
            files["off"].write(np.asarray(offsets, "<u8").tobytes())
            files["doc"].write(np.asarray(ids, "<i8").tobytes())
            for f in files.values():
                f.close()
            yield rows_batch(_PART, [[part], [len(ids)], [offsets[-1]], [enc.width]])

    parts = f"{folder}/parts"
    ordered.mapInArrow(write, _PART).write.parquet(parts)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    counted = spark.read.schema(_PART).parquet(parts)
    counted.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(f"{_PART}, base long").parquet(f"{folder}/manifest")


def mapped(fs, path: str, dtype: str) -> np.ndarray:
    """A file as an array; its pages stay in the file where it is local."""
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), dtype)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: ``doc_id, start`` (ids of all documents
    before it), ``n_tokens``, ``ids_crc32`` (of its ids as unsigned 32-bit)."""
    manifest = read_manifest(spark, folder)
    n = max(1, manifest.count())

    def read(batches):
        fs, path = filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                name = f"{path}/part-{row['part']:05d}"
                ids = mapped(fs, f"{name}.ids", f"<u{row['width']}")
                off = mapped(fs, f"{name}.off", "<u8").astype(np.int64)
                doc = mapped(fs, f"{name}.doc", "<i8")
                for lo in range(0, len(doc), 10_000):
                    hi = min(len(doc), lo + 10_000)
                    crc = [zlib.crc32(ids[off[i]:off[i + 1]].astype("<u4").tobytes()) for i in range(lo, hi)]
                    docs = pa.array(doc[lo:hi], mask=doc[lo:hi] == NO_DOC)
                    yield rows_batch(_DOC, [docs, off[lo:hi] + row["base"], np.diff(off[lo:hi + 1]), crc])

    return manifest.repartition(n, "part").mapInArrow(read, _DOC)


def token_files(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Write ``docs`` to ``folder`` (by default a new one in the shared folder) and read them back."""
    folder = folder or shared_folder(spark, "token-files")
    write_token_files(docs, folder, tokenizer, end_id)
    return read_token_files(spark, folder)
