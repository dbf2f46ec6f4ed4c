"""Approximate nearest neighbours by cross-polytope hashing.

Unit vectors are turned by fast Hadamard pseudo-rotations (three rounds of random
signs and a Walsh-Hadamard transform) and assigned to the nearest signed axis. Several
tables use independent rotations; a query probes the axes nearest to it in each. The
candidates of a bucket are scored exactly, by the inner product of the original
vectors in double precision, in blocks of bounded size; every candidate of a probed
bucket is scored, none is capped. Results of the tables are merged per query.

Defined results: vectors that are null, zero or hold null or non-finite components
take no part. Vectors of other lengths are compared only with their own length. A
query's own row (equal id) is no candidate; repeated rows of one id count once per
distinct vector, the better score wins. Ties go to the smaller id. Queries whose probed
buckets hold fewer than k candidates search every row in blocks, so they return
min(k, all). Extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TABLES = 8
PROBES = 20  # signed axes probed in each table, of twice the dimension
LEAST_BLOCK, MOST_BLOCK = 512, 1 << 16  # rows of one side scored together
SEED = 11


def rotate(x: np.ndarray, table: int) -> np.ndarray:
    """Pseudo-rotation of the rows, padded to a power of two."""
    size = 1 << max(0, (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), size))
    y[:, : x.shape[1]] = x
    rng = np.random.default_rng([SEED, table, size])
    for _ in range(3):
        y *= rng.choice((-1.0, 1.0), size)
        step = 1
        while step < size:
            pair = y.reshape(len(y), -1, 2, step)
            y = np.concatenate((pair[:, :, :1] + pair[:, :, 1:], pair[:, :, :1] - pair[:, :, 1:]), axis=2).reshape(len(y), size)
            step *= 2
        y /= math.sqrt(size)
    return y


def axes(x: np.ndarray, table: int, probes: int) -> np.ndarray:
    """The ``probes`` nearest signed axes of each row, nearest first: axis i or i + dimension for its negative."""
    y = rotate(x, table)
    both = np.concatenate((y, -y), axis=1)
    return np.argsort(-both, axis=1, kind="stable")[:, :probes]


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products, summed in order of the components so that equal vectors tie exactly."""
    out = np.zeros((len(q), len(c)))
    for d in range(q.shape[1]):
        out += q[:, d, None] * c[None, :, d]
    return out


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id and v (array of double) of the vectors that take part, repeated rows once."""
    v = F.col(vec_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False))).distinct()


def _hashed(rows: DataFrame, tables: int, probes: int) -> DataFrame:
    """id, v and (table, bucket) for each table and probe."""

    @F.pandas_udf("array<int>")
    def probe(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            size = batch.map(len)
            out = pd.Series([None] * len(batch), dtype=object)
            for n in size.unique():
                at = np.flatnonzero(size == n)
                x = np.stack(batch.iloc[at].to_list()).astype(float)
                x = x / np.linalg.norm(x / np.abs(x).max(axis=1, keepdims=True), axis=1, keepdims=True)
                width = 2 << max(0, (int(n) - 1).bit_length())
                found = np.concatenate([axes(x, t, min(probes, width)) + t * width for t in range(tables)], axis=1)
                for i, row in zip(at, found):
                    out[i] = row
            yield out

    return rows.withColumn("bucket", F.explode(probe("v"))).withColumn("dim", F.size("v"))


def search(
    vectors: DataFrame, queries: DataFrame, k: int, scratch: Callable[[DataFrame], DataFrame], id_col: str = "vec_id",
    vec_col: str = "embedding", tables: int = TABLES, probes: int = PROBES,
) -> DataFrame:
    """``k`` nearest rows of each query: query_id, rank, vec_id, score."""
    base = usable(vectors, id_col, vec_col)
    asked = usable(queries, id_col, vec_col)
    index = _hashed(base, tables, 1)
    probing = _hashed(asked, tables, probes)
    index, probing = scratch(index), scratch(probing)
    # Buckets well above the mean are cut into blocks on both sides; the layout does not change results.
    counts, q_counts = (scratch(x.groupBy("dim", "bucket").agg(F.count("*").alias("n"))) for x in (index, probing))
    blocks, q_blocks = (F.ceil(F.col("n") / _block(x)).cast("int") for x in (counts, q_counts))
    counts, q_counts = counts.select("dim", "bucket", blocks.alias("c_blocks")), q_counts.select("dim", "bucket", q_blocks.alias("q_blocks"))
    grid = counts.join(q_counts, ["dim", "bucket"])
    return _ranked(_pairs(index, probing, grid, k), k, base, asked, scratch)


def _block(counts: DataFrame) -> int:
    """Rows of a block: twice the mean of the buckets, within limits."""
    return min(MOST_BLOCK, max(LEAST_BLOCK, 2 * math.ceil(counts.agg(F.avg("n")).first()[0] or 0)))


def _pairs(index: DataFrame, probing: DataFrame, grid: DataFrame, k: int) -> DataFrame:
    """Best k ids of each query within each pair of blocks; the rows of an id are in one block."""
    keys = ["dim", "bucket", "c_block", "q_block"]
    left = (
        probing.join(grid, ["dim", "bucket"])
        .withColumn("q_block", F.pmod(F.xxhash64("id", F.lit(1)), "q_blocks").cast("int"))
        .withColumn("c_block", F.explode(F.sequence(F.lit(0), F.col("c_blocks") - 1)))
        .select(*keys, "id", "v")
    )
    right = (
        index.join(grid, ["dim", "bucket"])
        .withColumn("c_block", F.pmod(F.xxhash64("id"), "c_blocks").cast("int"))
        .withColumn("q_block", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)))
        .select(*keys, "id", "v")
    )

    def best(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        c = c.sort_values("id", kind="stable")
        cv = np.stack(c["v"].to_list()).astype(float)
        # Vectors of one id stand together; the best of them is the score of the id.
        ids, starts = np.unique(c["id"].to_numpy(), return_index=True)
        out = []
        for i in range(0, len(q), 256):
            part = q.iloc[i : i + 256]
            s = scores(np.stack(part["v"].to_list()).astype(float), cv)
            if len(ids) < len(cv):
                s = np.maximum.reduceat(s, starts, axis=1)
            for own, row in zip(part["id"].to_numpy(), s):
                row[ids == own] = -np.inf
                # The k-th best score bounds the candidates; equal scores are cut by id.
                low = np.partition(row, -k)[-k] if len(row) > k else -np.inf
                at = np.flatnonzero((row >= low) & (row > -np.inf))
                at = at[np.lexsort((ids[at], -row[at]))][:k]
                out.append(pd.DataFrame({"query_id": own, "vec_id": ids[at], "score": row[at]}))
        return pd.concat(out)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, "query_id long, vec_id long, score double")


def _merge(found: DataFrame, k: int) -> DataFrame:
    """Best k by query: at most k rows of each block arrive."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    row = F.struct((-F.col("score")).alias("m"), F.col("vec_id").alias("vec_id"))
    top = once.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(row)), 1, k).alias("top"))
    return top.select("query_id", F.posexplode("top").alias("pos", "t")).select(
        "query_id", (F.col("pos") + 1).alias("rank"), "t.vec_id", (-F.col("t.m")).alias("score")
    )


def _ranked(found: DataFrame, k: int, base: DataFrame, asked: DataFrame, scratch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Merged results, completed for queries with fewer than k candidates."""
    merged = scratch(_merge(found, k))
    full = merged.where(F.col("rank") == k).select(F.col("query_id").alias("id"))
    short = scratch(asked.join(full, "id", "left_anti").withColumn("dim", F.size("v")))
    n_short = short.count()
    if not n_short:
        return merged
    rows = base.withColumn("dim", F.size("v"))
    n_rows = rows.count()
    grid = rows.select("dim").distinct().select(
        "dim", F.lit(-1).alias("bucket"), F.lit(max(1, math.ceil(n_rows / LEAST_BLOCK))).alias("c_blocks"), F.lit(max(1, math.ceil(n_short / LEAST_BLOCK))).alias("q_blocks")
    )
    rest = _merge(_pairs(rows.withColumn("bucket", F.lit(-1)), short.withColumn("bucket", F.lit(-1)), grid, k), k)
    return merged.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(rest)
