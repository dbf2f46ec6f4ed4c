"""Embedding whitening by mixed-precision eigenvectors of a distributed covariance.

Entries become integers (``floor(64 c) + 1000000``), so sums and products of centred
entries are added exactly and the covariance does not depend on the order of tasks or
on a task that ran twice. Its eigenvectors are taken in float32 and corrected by the
matrix-multiplication iteration of Ogita and Aishima in double and then extended
precision; eigenvalues that lie closer together than the iteration can separate are
solved as small problems of their own inside their subspace.

Defined results. Rows whose vector is null, holds null or non-finite entries, or entries
beyond what a long can hold, are left out, and so are vectors of another length than the
commonest (the longest of several). The fit list is each distinct vector once; repeated
rows and ids are transformed each. Directions without variance (rank below the
dimension, a single vector, empty vectors) give no components; an empty table gives no
rows. Equal eigenvalues may come with any basis of their space. Memory: a few square
matrices of the dimension on the driver and in each task, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 16
SCALE, OFFSET = 64, 1_000_000
EXACT = 2.0**53  # float64 holds every integer up to here
LIMIT = 2**63 - 1
RANK_TOLERANCE = 1e-12  # of the largest eigenvalue; below it a direction has no variance
PRODUCT_ROWS = 8192
EXTENDED_DIMENSION = 512  # extended precision has no fast product; beyond it double is kept


@dataclass(frozen=True)
class Whitening:
    """``vectors`` has one unit eigenvector a column, by falling ``values``."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def shift(self) -> np.ndarray:
        """Integer nearest to each mean."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace


def quantized(vectors: DataFrame, column: str = "embedding", out: str = "x") -> DataFrame:
    """Rows with a usable vector, with ``out`` as array of longs."""
    scaled = f"CAST(c AS DOUBLE) * {SCALE}D"
    whole = f"{column} IS NOT NULL AND forall({column}, c -> coalesce(abs({scaled}) < 9.0e18D, false))"
    rows = vectors.where(whole).withColumn(out, F.expr(f"transform({column}, c -> CAST(floor({scaled}) AS BIGINT) + {OFFSET}L)"))
    lengths = rows.groupBy(F.size(out).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.where(F.size(out) == lengths[0].d) if lengths else rows


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _products(y: np.ndarray) -> np.ndarray:
    """``y.T @ y`` of integers without rounding, as Python integers."""
    total = np.zeros((y.shape[1], y.shape[1]), object)
    top = max(int(y.max(initial=0)), -int(y.min(initial=0)))
    if top * top >= EXACT:  # a single product would be rounded
        whole = y.astype(object)
        return whole.T @ whole
    step = max(1, min(PRODUCT_ROWS, int(EXACT // max(1, top * top))))
    for i in range(0, len(y), step):
        part = y[i : i + step].astype(np.float64)
        total += (part.T @ part).astype(np.int64).astype(object)
    return total


def _sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sum of each dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, object)
        for batch in batches:
            x = _matrix(batch.column(0))
            n += len(x)
            total += x.astype(object).sum(axis=0) if len(x) and np.abs(x.astype(float)).max(initial=0) * len(x) > 2.0**62 else x.sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, d)), pa.array([str(n), *map(str, total)])], ["i", "v"])

    parts = fit.select("x").mapInArrow(add, "i long, v string")
    rows = parts.groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).orderBy("i").collect()
    return int(rows[0].v), [int(r.v) for r in rows[1:]]


def _centred_products(fit: DataFrame, shift: np.ndarray) -> np.ndarray:
    """Exact sums of the products of entries less ``shift``."""
    d = len(shift)
    at = np.triu_indices(d)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d), object)
        for batch in batches:
            total += _products(_matrix(batch.column(0)) - shift)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(at[0]))), pa.array([str(v) for v in total[at]])], ["i", "v"])

    parts = fit.select("x").mapInArrow(add, "i long, v string")
    out = np.zeros((d, d), object)
    for r in parts.groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():
        i, j = at[0][r.i], at[1][r.i]
        out[i, j] = out[j, i] = int(r.v)
    return out


def refine(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One correction of approximate eigenvectors ``x`` of ``a`` in their precision:
    eigenvalues, corrected vectors, and the gap below which two eigenvalues are one."""
    eye = np.eye(len(a), dtype=a.dtype)
    r = eye - x.T @ x
    s = x.T @ (a @ x)
    values = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(np.diag(s))
    gap = 2 * (np.linalg.norm(off.astype(float)) + np.abs(values).max() * np.linalg.norm(r.astype(float)))
    apart = values[None, :] - values[:, None]
    near = np.abs(apart) <= gap
    e = np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1, apart))
    return values, x + x @ e, float(gap)


def _clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Runs of eigenvalues whose neighbours lie within ``gap``."""
    order = np.argsort(-values, kind="stable")
    cuts = np.flatnonzero(-np.diff(values[order]) > gap) + 1
    return [c for c in np.split(order, cuts) if len(c) > 1]


def _solve_cluster(a: np.ndarray, x: np.ndarray, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Rotate the vectors of a cluster inside their subspace: eigenvectors of the small
    matrix that is left when the cluster's mean eigenvalue is taken off."""
    basis = x[:, at]
    middle = values[at].mean()
    small = basis.T @ (a @ basis) - middle * (basis.T @ basis)
    small = (small + small.T) / 2
    size = np.abs(small).max()
    if size == 0:
        return basis
    _, turn = np.linalg.eigh((small / size).astype(np.float64))
    return basis @ turn[:, ::-1].astype(x.dtype)


def eigenvectors(v: np.ndarray, steps: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues by falling size and unit eigenvectors of a symmetric matrix of any float type."""
    size = float(np.abs(v).max(initial=0)) or 1.0
    scaled = v / v.dtype.type(size)
    _, x = np.linalg.eigh(scaled.astype(np.float32))
    wide = np.longdouble if len(v) <= EXTENDED_DIMENSION else np.float64
    values = np.zeros(len(v))
    for kind in (np.float64, wide):
        a, x = scaled.astype(kind), x.astype(kind)
        least = np.inf
        for _ in range(steps):
            values, fresh, gap = refine(a, x)
            if not np.isfinite(fresh).all():
                break
            x = fresh
            groups = _clusters(values, gap)
            for at in groups:
                x[:, at] = _solve_cluster(a, x, at, values)
            if groups:  # the rotations keep the space; one plain step makes it orthonormal again
                x = x + x @ ((np.eye(len(a), dtype=kind) - x.T @ x) / 2)
            if gap >= least / 2:  # no progress: the precision's own error is reached
                break
            least = gap
    for _ in range(2):  # equal eigenvalues: what is left is only how far the basis is from orthonormal
        x = x + x @ ((np.eye(len(v), dtype=x.dtype) - x.T @ x) / 2)
    x = x / np.sqrt((x * x).sum(axis=0))
    values = (x * (scaled.astype(x.dtype) @ x)).sum(axis=0) * size
    order = np.argsort(-values, kind="stable")
    return values[order], x[:, order]


def fit(rows: DataFrame, store: Callable[[DataFrame], DataFrame], components: int = COMPONENTS) -> tuple[Whitening | None, DataFrame]:
    """Whitening of the distinct ``x`` of ``rows``, and the stored fit list; None if there is nothing to fit."""
    distinct = store(rows.select("x").distinct())
    first = distinct.limit(1).collect()
    if not first or not len(first[0].x):
        return None, distinct
    n, sums = _sums(distinct, len(first[0].x))
    start = Whitening(n, tuple(sums), np.zeros(0), np.zeros((len(sums), 0)), 1.0)
    shift = start.shift
    products = _centred_products(distinct, shift)
    rest = [s - n * int(m) for s, m in zip(sums, shift)]
    cov = np.array([[_extended(n * products[i, j] - rest[i] * rest[j], n * n) for j in range(len(sums))] for i in range(len(sums))], np.longdouble)
    values, vectors = eigenvectors(cov)
    keep = int((values > max(RANK_TOLERANCE * float(values[0]), 0.0)).sum()) if values[0] > 0 else 0
    keep = min(keep, components)
    return Whitening(n, tuple(sums), values[:keep].astype(np.float64), vectors[:, :keep].astype(np.float64), float(np.trace(cov))), distinct


def _extended(over: int, under: int) -> np.longdouble:
    """A fraction in extended precision: its double and the double of what is left."""
    exact = Fraction(over, under)
    high = float(exact)
    return np.longdouble(high) + np.longdouble(float(exact - Fraction(high)))


def _projector(model: Whitening) -> Callable[[np.ndarray], np.ndarray]:
    """Function from rows of x to whitened rows: small integers less a remainder below one."""
    shift = model.shift
    rest = np.array([float(Fraction(s - model.n * int(m), model.n)) for s, m in zip(model.sums, shift)])
    scale = model.vectors / np.sqrt(model.values)
    return lambda x: ((x - shift).astype(np.float64) - rest) @ scale


def _deviations(model: Whitening) -> Callable[[np.ndarray], list[int | None]]:
    """Function from rows of x to the exact sum of (n x - S)^2; null beyond a long."""
    shift = model.shift
    rest = np.array([s - model.n * int(m) for s, m in zip(model.sums, shift)], object)

    def deviation(x: np.ndarray) -> list[int | None]:
        y = x - shift
        top = max(int(y.max(initial=0)), -int(y.min(initial=0))) * model.n + max(map(abs, rest), default=0)
        if top * top * y.shape[1] <= LIMIT:
            return ((y * model.n - rest.astype(np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((y.astype(object) * model.n - rest) ** 2).sum(axis=1)
        return [int(v) if v <= LIMIT else None for v in exact]

    return deviation


def identity_error(distinct: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance less the identity."""
    k = len(model.values)
    shared = distinct.sparkSession.sparkContext.broadcast(model)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whiten, total = _projector(shared.value), np.zeros((k + 1, k))
        for batch in batches:
            w = whiten(_matrix(batch.column(0)))
            total[0] += w.sum(axis=0)
            total[1:] += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size)), pa.array(total.ravel())], ["i", "v"])

    parts = distinct.select("x").mapInArrow(add, "i long, v double")
    flat = np.zeros((k + 1) * k)
    for r in parts.groupBy("i").agg(F.sum("v").alias("v")).collect():
        flat[r.i] = r.v
    total = flat.reshape(k + 1, k) / model.n
    cov = total[1:] - np.outer(total[0], total[0])  # the means are zero but for rounding
    return float(np.abs(cov - np.eye(k)).max())


def transform(rows: DataFrame, model: Whitening) -> DataFrame:
    """Add ``whitened`` (one double a component) and ``deviation`` to rows with ``x``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("whitened array<double>, deviation long")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        whiten, deviation = _projector(shared.value), _deviations(shared.value)
        d = len(shared.value.sums)
        for batch in batches:
            for i in range(0, max(len(batch), 1), PRODUCT_ROWS):
                part = batch.iloc[i : i + PRODUCT_ROWS]
                x = np.stack(part.to_list()) if len(part) else np.zeros((0, d), np.int64)
                yield pd.DataFrame({"whitened": list(whiten(x)), "deviation": pd.array(deviation(x), "Int64")})

    own = ["whitened", "deviation"]
    found = rows.select(F.struct(*[rows[f"`{c}`"] for c in rows.columns]).alias("row"), apply(F.col("x")).alias("found"))
    return found.select(*[F.col(f"row.`{c}`") for c in rows.columns if c not in own], *[F.col(f"found.{c}") for c in own])


def whiten(vectors: DataFrame, key: str, store: Callable[[DataFrame], DataFrame], column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: ``key, component, n, deviation, whitened, explained, identity_error``."""
    rows = quantized(vectors.select(F.col(key).alias("key"), F.col(column).alias("v")), "v").drop("v")
    model, distinct = fit(rows, store, components)
    if model is None or not len(model.values):
        return rows.where(F.lit(False)).select(
            F.col("key").alias(key), F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"),
            *[F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error")],
        )
    share = F.array(*[F.lit(float(e)) for e in model.explained])
    return transform(rows, model).select("key", "deviation", F.posexplode("whitened").alias("p", "whitened")).select(
        F.col("key").alias(key), (F.col("p") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        "whitened", F.get(share, F.col("p")).alias("explained"), F.lit(identity_error(distinct, model)).alias("identity_error"),
    )
