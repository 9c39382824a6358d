"""What several operators share: interim tables, Arrow helpers, worker caches."""

from __future__ import annotations

import ctypes
import functools
import gc
import sys
import types
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no ``spark.checkpoint.dir`` (tests).
DEFAULT_FOLDER = "file:///tmp/checkpoints"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one the cluster names in ``spark.checkpoint.dir``."""
    base = spark.conf.get("spark.checkpoint.dir", None) or DEFAULT_FOLDER
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"


def cut(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: later steps
    start from files that outlive any executor."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of steps that are finished: Spark drops them once
    the driver's collectors see that nothing refers to their plans any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def worker_store() -> dict:
    """Values kept for the life of a Python worker (a tokenizer, a lookup table)."""
    home = sys.modules.setdefault("_llm_worker_store", types.ModuleType("_llm_worker_store"))
    return home.__dict__.setdefault("values", {})


#: Where the store says which of its values is the large one.
_LARGE = "_large"


def kept(key, make, large: bool = False):
    """``make()``, once per Python worker. A ``large`` value goes as soon as any other is
    asked for: workers outlive their step, and what a step kept would lie beside the next."""
    store = worker_store()
    if store.get(_LARGE, key) != key:
        store.pop(store.pop(_LARGE), None)
    if key not in store:
        store[key] = make()
    if large:
        store[_LARGE] = key
    return store[key]


def give_back() -> None:
    """Return memory that is free to the system: allocators hold on to it, and a worker
    would carry the peak of every step to the end of the application."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # GNU only
    if trim is not None:
        trim(0)


def lean(run):
    """``run``, a function for ``mapInArrow``, whose worker gives back free memory at its end."""
    @functools.wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()
    return whole


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """A string column's values as UTF-8 bytes, without decoding them."""
    return column.cast(pa.binary() if column.type == pa.string() else pa.large_binary()).to_pylist()


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of plain columns given as ``name type, ...``."""
    kinds = {
        "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
        "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()),
        "array<int>": pa.list_(pa.int32()),
    }
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ddl.split(", "))])


def rows_batch(ddl: str, columns: list) -> pa.RecordBatch:
    """A record batch of ``columns`` (lists or arrays) in the order of ``ddl``."""
    schema = arrow_schema(ddl)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def carried(docs: DataFrame, columns: list[str]) -> tuple[list, str]:
    """For an operator that hands ``columns`` of a row on beside its result: what to
    read after doc_id and text, and what to add to the result's schema."""
    kinds = {n: {"bigint": "long"}.get(t, t) for n, t in docs.dtypes}
    read = [F.col("doc_id").cast("long"), F.col("text").cast("string"), *[c for c in columns if c != "text"]]
    return read, "".join(f", {c} {kinds[c]}" for c in columns)


def sha256_join(items: Column) -> Column:
    """Lowercase hex SHA-256 of an array of strings, comma-joined."""
    return F.sha2(F.array_join(items, ",").cast("binary"), 256)
