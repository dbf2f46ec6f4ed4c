"""Whitening against a plain eigenvalue solver, and eigenvectors of clustered matrices."""

import math

import numpy as np
import pytest

from docframe.llm import queries, whitening
from docframe.session import materialize

SCHEMA = "vec_id long, embedding array<double>"


def matrix(values, seed=0):
    d = len(values)
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
    a = (q.astype(np.longdouble) * np.array(values, np.longdouble)) @ q.T.astype(np.longdouble)
    return (a + a.T) / 2


@pytest.mark.parametrize(
    "values",
    [
        list(np.linspace(1, 5, 40)), [3.0] * 10 + [2.0] * 20 + list(np.linspace(0.1, 1, 30)), [1.0] * 24, [7.0],
        [3 + 1e-9 * i for i in range(10)] + [2 + 1e-13 * i for i in range(20)], list(10.0 ** -np.arange(12)) + [0.0] * 20,
        list(1 + 1e-8 * np.sin(np.arange(32))), [1e6, *np.linspace(0, 1, 31)],
    ],
)
def test_eigenvectors(values):
    a = matrix(values)
    found, x = whitening.eigenvectors(a)
    size = float(np.abs(a).max())
    assert np.abs((x.T @ x - np.eye(len(a))).astype(float)).max() < 1e-15
    assert np.abs((a @ x - x * found).astype(float)).max() < 1e-15 * size * len(a)
    assert np.allclose(found.astype(float), sorted(values, reverse=True), rtol=0, atol=1e-14 * size * len(a))


def test_one_refinement_brings_float32_to_more_digits():
    a = matrix(np.linspace(1, 5, 40)).astype(float)
    _, x = np.linalg.eigh(a.astype(np.float32))
    before = np.abs(x.T.astype(float) @ x - np.eye(40)).max()
    _, y, _ = whitening.refine(a, x.astype(float))
    assert np.abs(y.T @ y - np.eye(40)).max() < before / 1000


def plain(vectors):
    """Whitened rows (up to signs), eigenvalue shares and deviations by numpy and Python integers."""
    x = [[math.floor(64 * float(c)) + 1000000 for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array(fit, float) - np.array(sums) / n
    values, vecs = np.linalg.eigh(y.T @ y / n)
    values, vecs = values[::-1][:16], vecs[:, ::-1][:, :16]
    white = (np.array(x, float) - np.array(sums) / n) @ vecs / np.sqrt(values)
    return n, white, values / (y * y).sum() * n, [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x]


def test_against_numpy_through_the_registered_query(spark, tmp_path):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 24)) @ np.diag(np.linspace(0.05, 2, 24))
    v[50:120] = v[50]  # repeated vectors count once in the fit list
    v = v.astype(np.float32)
    odd = [(900, None), (901, [None, *v[0][1:].tolist()]), (902, [math.nan, *v[0][1:].tolist()]), (903, [math.inf, *v[0][1:].tolist()]), (904, [1.0])]
    rows = [(i, row.tolist()) for i, row in enumerate(v)] + odd
    spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op11_whitening(spark, str(tmp_path)).toPandas()
    n, white, explained, deviation = plain(v.tolist())
    assert len(got) == 300 * 16 and set(got.n) == {n} and got.identity_error.max() < 1e-10 and got.identity_error.nunique() == 1
    table = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    sign = np.sign((table * white).sum(axis=0))
    assert np.allclose(table * sign, white, atol=1e-8)
    first = got[got.component == 1].sort_values("vec_id")
    assert first.deviation.tolist() == deviation
    assert np.allclose(got[got.vec_id == 0].sort_values("component").explained, explained, rtol=1e-9)


def whitened(spark, rows):
    return whitening.whiten(spark.createDataFrame(rows, SCHEMA), "vec_id", materialize).collect()


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, []), (2, [])], [(1, None)], [(1, [2.0, 1.0]), (2, [2.0, 1.0])]])
def test_nothing_to_whiten(spark, rows):
    assert whitened(spark, rows) == []


def test_repeated_ids_null_ids_and_low_rank(spark):
    rows = [(1, [2.0, 1.0, 0.0]), (1, [2.0, 1.0, 0.0]), (None, [3.0, 1.0, 0.0]), (4, [9.0]), (5, [float("inf"), 0.0, 0.0])]
    got = whitened(spark, rows)
    assert sorted(((r.vec_id, r.component, r.n, r.deviation) for r in got), key=repr) == sorted(
        [(1, 1, 2, 4096), (1, 1, 2, 4096), (None, 1, 2, 4096)], key=repr
    )
    assert sorted(abs(r.whitened) for r in got) == [1.0, 1.0, 1.0] and {r.explained for r in got} == {1.0}


def test_huge_entries_stay_exact(spark):
    rows = [(1, [1e9, 0.0]), (2, [-1e9, 0.5]), (3, [0.25, 1.0])]
    d = {r.vec_id: r.deviation for r in whitened(spark, rows)}
    assert d == {1: None, 2: None, 3: 10240}  # two are beyond a long
    small = whitened(spark, [(i, [x * 1e6 for x in v]) for i, v in enumerate([(1.0, 0.0), (-1.0, 0.5), (0.0, 1.0)])])
    assert {r.vec_id: r.deviation for r in small} == dict(enumerate(plain([[1e6, 0.0], [-1e6, 5e5], [0.0, 1e6]])[3]))


def test_shape_of_the_sums_does_not_matter(spark):
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 5)))]
    one = whitening.whiten(spark.createDataFrame(rows, SCHEMA).coalesce(1), "vec_id", materialize)
    many = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(9), "vec_id", materialize)
    columns = ["vec_id", "component", "whitened", "explained", "deviation"]
    assert sorted(map(tuple, one.select(*columns).collect())) == sorted(map(tuple, many.select(*columns).collect()))
