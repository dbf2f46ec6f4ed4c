"""An inverted-file index over vectors (R3, approximate form).

Centroids are fitted on a bounded sample and every vector is stored in the folder of its
nearest centroid. A search looks into the cells nearest to each query only and ranks what
it finds there exactly. How many cells that takes is measured when the index is written:
sampled vectors are searched exactly and through growing numbers of cells, and the first
number that reaches the wanted recall is kept with the index.

A cell may hold any share of the vectors: cells are searched in tiles (``dense_topk``).
Vectors that are null, empty, of another dimension, zero or not finite are left out.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.operators.retrieval import dense_topk

CELL_VECTORS = 1000  # vectors of a cell on average, while there are fewer than MAX_CELLS
MAX_CELLS = 4096
SAMPLE_PER_CELL = 64  # vectors the centroids are fitted on, per cell
MEASURED = 100  # vectors searched both ways to choose the number of probes
ROUNDS = 12


@dataclass(frozen=True)
class VectorIndex:
    """``recall`` was measured at ``k`` neighbours with ``probes`` cells a query."""

    path: str
    centroids: np.ndarray
    scope: tuple[str, ...]
    probes: int
    recall: float
    k: int

    def cells(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/cells")


def _usable(vectors: DataFrame, dimension: int | None = None) -> DataFrame:
    sound = "size(embedding) > 0 AND forall(embedding, x -> coalesce(abs(CAST(x AS DOUBLE)) < 1e300D, false)) AND exists(embedding, x -> x <> 0)"
    rows = vectors.where("embedding IS NOT NULL").where(sound)
    return rows if dimension is None else rows.where(F.size("embedding") == dimension)


def _unit(rows: Sequence) -> np.ndarray:
    m = np.stack([np.asarray(r, np.float64) for r in rows])
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 1) -> np.ndarray:
    """Spherical k-means on unit vectors; a cell that loses all its vectors takes the worst fitted one."""
    rng = np.random.default_rng(seed)
    centres = sample[np.sort(rng.choice(len(sample), min(cells, len(sample)), replace=False))]
    for _ in range(rounds):
        best, score = np.empty(len(sample), np.int64), np.empty(len(sample))
        for i in range(0, len(sample), 4096):
            sims = sample[i : i + 4096] @ centres.T
            best[i : i + 4096], score[i : i + 4096] = sims.argmax(axis=1), sims.max(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, best, sample)
        empty = np.flatnonzero(np.bincount(best, minlength=len(centres)) == 0)
        sums[empty] = sample[np.argsort(score, kind="stable")[: len(empty)]]
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centres)
    return centres


def _nearest(spark: SparkSession, centroids: np.ndarray, n: int):
    """Expression for the numbers of the ``n`` nearest cells of a vector, nearest first."""
    shared = spark.sparkContext.broadcast(centroids.astype(np.float32))  # MAX_CELLS vectors at most

    @F.pandas_udf("array<int>")
    def cells(vectors: pd.Series) -> pd.Series:
        out: list[np.ndarray] = []
        for i in range(0, len(vectors), 1024):
            sims = _unit(vectors.iloc[i : i + 1024]).astype(np.float32) @ shared.value.T
            out += list(np.argsort(-sims, axis=1, kind="stable")[:, :n].astype(np.int32))
        return pd.Series(out, dtype=object)

    return cells


def build_index(
    corpus: DataFrame, path: str, *, scope: Sequence[str] = (), recall: float = 0.9, k: int = 10, cells: int | None = None
) -> VectorIndex:
    """Store ``corpus`` (chunk_id, embedding and the scope columns) by cells below ``path``."""
    spark = corpus.sparkSession
    rows = _usable(corpus.select("chunk_id", "embedding", *scope))
    sizes = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not sizes:
        raise ValueError("no usable vector")
    dimension, n = sizes[0].d, sizes[0].n
    rows = rows.where(F.size("embedding") == dimension)
    cells = cells or int(min(MAX_CELLS, max(1, round(n / CELL_VECTORS), round(n**0.5))))
    # The smallest hashes are a sample that does not depend on how the rows are dealt.
    order = F.xxhash64("chunk_id")
    sample = rows.select("embedding", order.alias("h")).orderBy("h").limit(cells * SAMPLE_PER_CELL).select("embedding").toPandas()["embedding"]
    centroids = fit_centroids(_unit(sample), cells)
    placed = rows.withColumn("cell", _nearest(spark, centroids, 1)("embedding")[0])
    # Rows of one cell are written by several tasks if it is large.
    placed.repartition(F.col("cell"), F.pmod(order, F.lit(8))).write.partitionBy("cell").parquet(f"{path}/cells")
    index = VectorIndex(path, centroids, tuple(scope), len(centroids), 1.0, k)
    index = _measured(index, spark, rows, recall, k)
    meta = {"scope": list(scope), "probes": index.probes, "recall": index.recall, "k": k, "dimension": dimension}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{path}/meta")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    return index


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    meta = json.loads(spark.read.text(f"{path}/meta").first().value)
    stored = spark.read.parquet(f"{path}/centroids").orderBy("cell").toPandas()["centroid"]
    return VectorIndex(path, np.stack(stored), tuple(meta["scope"]), meta["probes"], meta["recall"], meta["k"])


def _measured(index: VectorIndex, spark: SparkSession, rows: DataFrame, wanted: float, k: int) -> VectorIndex:
    """The index with the fewest probes (a power of two, or all cells) that reach ``wanted``."""
    asked = rows.select(F.col("chunk_id").alias("query_id"), "embedding", *index.scope, F.xxhash64("chunk_id", F.lit(2)).alias("h"))
    asked = spark.createDataFrame(asked.orderBy("h").limit(MEASURED).drop("h").collect(), asked.drop("h").schema)
    exact = dense_topk(index.cells(spark), asked, k, scope=index.scope).select("query_id", "chunk_id").toPandas()
    probes, found = 1, 0.0
    while True:
        probes = min(probes, len(index.centroids))
        near = search(index, asked, k, probes=probes).select("query_id", "chunk_id").toPandas()
        found = len(exact.merge(near, on=["query_id", "chunk_id"])) / max(1, len(exact))
        if found >= wanted or probes == len(index.centroids):
            return VectorIndex(index.path, index.centroids, index.scope, probes, float(found), k)
        probes *= 2


def probed(index: VectorIndex, queries: DataFrame, probes: int | None = None) -> DataFrame:
    """Queries (query_id, embedding, scope columns) with each ``cell`` they look into."""
    nearest = _nearest(queries.sparkSession, index.centroids, probes or index.probes)
    return _usable(queries, index.centroids.shape[1]).withColumn("cell", F.explode(nearest("embedding")))


def search(index: VectorIndex, queries: DataFrame, k: int, *, probes: int | None = None) -> DataFrame:
    """The ``k`` best of the probed cells per query, by exact cosine: query_id, chunk_id, score, rank.
    Only the folders of probed cells are read."""
    asked = probed(index, queries.select("query_id", "embedding", *index.scope), probes)
    wanted = [r.cell for r in asked.select("cell").distinct().collect()]  # MAX_CELLS numbers at most
    have = index.cells(queries.sparkSession).where(F.col("cell").isin(wanted))
    return dense_topk(have, asked, k, scope=[*index.scope, "cell"])


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Per query, the share of the exact neighbours that were found."""
    hits = exact.join(found.select("query_id", "chunk_id").withColumn("hit", F.lit(1)), ["query_id", "chunk_id"], "left")
    return hits.groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))

