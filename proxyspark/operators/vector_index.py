"""Approximate vector search: cells of a stored table, probed by a calibrated number.

Vectors are dealt to cells around centres, and a search reads the folders of the cells
whose centres are nearest to the query; what it reads is ranked by exact cosine. How many
cells that takes depends on the data (few if vectors cluster, most if they are noise), so
it is measured when the index is built, for a recall that is asked for.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proxyspark.operators.search import search_findings_vector

#: Centres are fitted on at most so many rows, and there are at most so many cells:
#: both bound the driver's memory. Every row is indexed.
SAMPLE, MAX_CELLS = 50_000, 4_096
#: Rows that stand in for queries when the number of probes is measured, the length of
#: their lists, and the share of true neighbours that probed cells must hold.
TRIALS, DEPTH, TARGET = 128, 20, 0.95
#: Rows and queries that are compared in one task; larger cells are cut into such blocks.
BLOCK = 16_384


def _usable(dims: int) -> Column:
    squares = F.aggregate("embedding", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    return (F.size("embedding") == dims) & (squares > 0) & (squares < float("inf"))


def _unit(rows) -> np.ndarray:
    found = np.array([np.asarray(r, dtype="f8") for r in rows])
    return found / np.linalg.norm(found, axis=1, keepdims=True) if len(found) else found.reshape(0, 0)


def _nearest(rows, centres: np.ndarray, probes: int) -> np.ndarray:
    if not centres.size:  # nothing was indexed
        return np.zeros((len(rows), 1), dtype=int)
    return np.argsort(-(_unit(rows) @ centres.T), axis=1, kind="stable")[:, :probes]


def build_index(vectors: DataFrame, path: str, id_col: str = "finding_id", dims: int | None = None,
                cells: int | None = None, target: float = TARGET) -> int:
    """Write ``vectors`` (id_col, embedding, and what else a search should give) as cells
    below ``path``; returns how many of them a search reads.

    Rows whose vector is missing, null within, zero, not finite or not of ``dims`` (by
    default the first one's) components have no direction and are left out. A cell that
    many rows fall into is many files.
    """
    spark = vectors.sparkSession
    if dims is None:
        first = vectors.where(F.size("embedding") > 0).select(F.size("embedding")).first()
        dims = first[0] if first else 0
    good = vectors.where(_usable(dims))
    n = good.count()
    wanted = min(MAX_CELLS, cells or max(1, round(n ** 0.5 / 2)))
    centres = np.zeros((1, dims))
    if n:
        sample = good.orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE)
        model = KMeans(k=wanted, seed=7, maxIter=15, distanceMeasure="cosine", featuresCol="_features").fit(
            sample.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("_features")))
        centres = _unit(model.clusterCenters())

    def deal(frames):
        for frame in frames:
            yield frame.assign(cell=_nearest(frame["embedding"], centres, 1)[:, 0] if len(frame) else [])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in good.schema) + ", cell int"
    good.mapInPandas(deal, schema).hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/cells")
    probes = _measured(spark, path, schema, id_col, centres, target) if n else 1
    model = [(i, [float(x) for x in c], probes, schema) for i, c in enumerate(centres)]
    spark.createDataFrame(model, "cell int, centre array<double>, probes int, columns string").coalesce(1).write.parquet(f"{path}/centres")
    return probes


def _measured(spark: SparkSession, path: str, schema: str, id_col: str, centres: np.ndarray, target: float) -> int:
    """Least number of cells that hold ``target`` of the trial rows' true neighbours."""
    rows = spark.read.schema(schema).parquet(f"{path}/cells")
    trials = rows.orderBy(F.xxhash64(id_col, F.lit("trial")), id_col).limit(TRIALS).select(id_col, "embedding").toPandas()
    queries, own = _unit(trials["embedding"]), list(trials[id_col])

    def best(frames):
        for frame in frames:
            if len(frame):
                scores = queries @ _unit(frame["embedding"]).T
                yield _top(scores, range(len(own)), own, frame, id_col, DEPTH, "cell")

    order = Window.partitionBy("q").orderBy(F.desc("rank"), "id")
    id_type = rows.schema[id_col].dataType.simpleString()
    found = (rows.select(id_col, "embedding", "cell").mapInPandas(best, f"q int, id {id_type}, rank double, cell int")
             .withColumn("place", F.row_number().over(order)).where(F.col("place") <= DEPTH).select("q", "cell").toPandas())
    if found.empty:
        return len(centres)
    place = np.argsort(np.argsort(-(queries @ centres.T), axis=1, kind="stable"), axis=1)
    needed = np.sort(place[found["q"], found["cell"]])
    return int(needed[int(np.ceil(target * len(needed))) - 1]) + 1


def _top(scores: np.ndarray, names, own: list, frame: pd.DataFrame, id_col: str, k: int, extra: str | None = None) -> pd.DataFrame:
    """The ``k`` best rows of ``frame`` per query, its own row left out, ties to smaller ids."""
    ids, parts = frame[id_col].to_numpy(), []
    for i, name in enumerate(names):
        other = np.flatnonzero(ids != own[i])
        line = scores[i][other]
        if len(line) > k:
            keep = line >= np.partition(line, len(line) - k)[len(line) - k]
            other, line = other[keep], line[keep]
        first = np.lexsort((ids[other], -line))[:k]
        part = {"q": name, "id": ids[other][first], "rank": line[first]}
        parts.append(pd.DataFrame(part | ({extra: frame[extra].to_numpy()[other][first]} if extra else {})))
    return pd.concat(parts)


def _opened(spark: SparkSession, path: str) -> tuple[DataFrame, np.ndarray, int]:
    """Rows with their cell, the centres, and how many cells a search reads."""
    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
    cells = spark.read.schema(rows[0]["columns"]).parquet(f"{path}/cells")
    return cells, np.array([r["centre"] for r in rows]), rows[0]["probes"]


def search_index(spark: SparkSession, path: str, query: list[float], n: int | None = None,
                 id_col: str = "finding_id", probes: int | None = None) -> DataFrame:
    """Nearest rows to one vector; only the folders of the probed cells are read."""
    cells, centres, usual = _opened(spark, path)
    near = [int(c) for c in _nearest([query], centres, probes or usual)[0]]
    rows = cells.where(F.col("cell").isin(near)).drop("cell")
    return search_findings_vector(rows, query, n, id_col)


def search_each(spark: SparkSession, path: str, queries: DataFrame, k: int, id_col: str = "finding_id",
                probes: int | None = None) -> DataFrame:
    """``query_id, id, rank`` of the ``k`` nearest rows of every row of ``queries`` (id_col,
    embedding), itself left out; for any number of queries.

    Queries and rows meet per cell in blocks, and each block gives its best ``k`` only.
    """
    cells, centres, usual = _opened(spark, path)
    rows = cells.select(id_col, "embedding", "cell")
    id_type, width = rows.schema[id_col].dataType.simpleString(), probes or usual

    def probe(frames):
        for frame in frames:
            near = _nearest(frame["embedding"], centres, width) if len(frame) else []
            yield frame.assign(cells=list(near))

    asked = queries.where(_usable(centres.shape[1])).select(id_col, "embedding").mapInPandas(
        probe, f"`{id_col}` {id_type}, embedding array<double>, cells array<int>").withColumn("cell", F.explode("cells")).drop("cells")
    blocks = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    sizes = blocks(rows, "row_blocks").join(blocks(asked, "query_blocks"), "cell")
    place = lambda of: F.pmod(F.xxhash64(id_col), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = rows.join(sizes, "cell").select(id_col, "embedding", "cell", place("row_blocks").alias("a"), every("query_blocks").alias("b"))
    right = asked.join(sizes, "cell").select(id_col, "embedding", "cell", place("query_blocks").alias("b"), every("row_blocks").alias("a"))

    def compare(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or asked.empty:
            return pd.DataFrame({"q": [], "id": [], "rank": []})
        ids, known, parts = list(asked[id_col]), _unit(rows["embedding"]).T, []
        for at in range(0, len(ids), 256):  # scores of a few queries at a time
            some = ids[at:at + 256]
            parts.append(_top(_unit(asked["embedding"][at:at + 256]) @ known, some, some, rows, id_col, k))
        return pd.concat(parts)

    met = left.groupBy("cell", "a", "b").cogroup(right.groupBy("cell", "a", "b")).applyInPandas(compare, f"q {id_type}, id {id_type}, rank double")
    order = Window.partitionBy("q").orderBy(F.desc("rank"), "id")
    return met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select(
        F.col("q").alias("query_id"), "id", "rank")
