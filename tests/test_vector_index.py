"""Inverted-file vector index against exact search."""

import numpy as np
import pytest

from docframe.operators import retrieval as rt
from docframe.operators import vector_index as vi
from docframe.session import scratch_path

SCHEMA = "chunk_id long, embedding array<float>, paper_id string"


def brute(vectors, queries, k):
    ids = np.array([i for i, v in vectors])
    m = np.array([v for _, v in vectors], np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    out = set()
    for q, v in queries:
        v = np.array(v, np.float32).astype(float)
        best = np.lexsort((ids, -np.round(m @ (v / np.linalg.norm(v)), 10)))[:k]
        out |= {(q, int(ids[i])) for i in best}
    return out


def pairs(df):
    return {(r.query_id, r.chunk_id) for r in df.collect()}


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 64))
    return [(i, (centres[i % 40] + 0.6 * rng.normal(size=64)).tolist(), "ab"[i % 2]) for i in range(4000)]


def test_recall_and_rows_read(spark, clustered):
    corpus = spark.createDataFrame(clustered, SCHEMA)
    index = vi.build_index(corpus, scratch_path(spark, "vectors"), k=10)
    asked = [(i, v) for i, v, _ in clustered if i % 50 == 0]
    queries = spark.createDataFrame(asked, "query_id long, embedding array<float>")
    want = brute([r[:2] for r in clustered], asked, 10)
    got = pairs(vi.search(index, queries, 10))
    assert index.recall >= 0.9 and len(got & want) >= 0.9 * len(want)
    read = vi.probed(index, queries).join(index.cells(spark).groupBy("cell").count(), "cell").agg({"count": "sum"}).first()[0]
    assert read < 0.25 * len(clustered) * len(asked)
    assert pairs(vi.search(index, queries, 10, probes=len(index.centroids))) == want
    plan = vi.search(index, queries.limit(1), 10, probes=1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "cell#" in plan.split("PartitionFilters: [")[1]


def test_vectors_without_clusters_take_more_probes(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=64).tolist(), "a") for i in range(1500)]
    index = vi.build_index(spark.createDataFrame(rows, SCHEMA), scratch_path(spark, "vectors"), k=5)
    asked = [(i, v) for i, v, _ in rows if i % 25 == 0]
    got = pairs(vi.search(index, spark.createDataFrame(asked, "query_id long, embedding array<float>"), 5))
    want = brute([r[:2] for r in rows], asked, 5)
    assert len(got & want) >= 0.85 * len(want) and index.probes > 1


def test_one_cell_with_most_vectors(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [1.0, 0.0, 0.0, 0.0], "a") for i in range(600)] + [(1000 + i, rng.normal(size=4).tolist(), "a") for i in range(300)]
    index = vi.build_index(spark.createDataFrame(rows, SCHEMA), scratch_path(spark, "vectors"), k=5)
    queries = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0])], "query_id long, embedding array<float>")
    got = vi.search(index, queries, 7).collect()
    assert [r.chunk_id for r in sorted(got, key=lambda r: r.rank)] == list(range(7))


def test_scopes_odd_vectors_and_reopening(spark, clustered):
    odd = [(9001, None, "a"), (9002, [], "a"), (9003, [0.0] * 64, "a"), (9004, [float("nan")] * 64, "a"), (9005, [1.0], "a"), (9006, [None] * 64, "a")]
    corpus = spark.createDataFrame(clustered[:800] + odd, SCHEMA)
    path = scratch_path(spark, "vectors")
    vi.build_index(corpus, path, scope=["paper_id"], k=5)
    index = vi.open_index(spark, path)
    assert index.cells(spark).count() == 800 and index.scope == ("paper_id",)
    asked = [(i, v, p) for i, v, p in clustered[:800] if i % 40 < 2] + [(7000, None, "a"), (7001, [0.0] * 64, "a")]
    queries = spark.createDataFrame(asked, "query_id long, embedding array<float>, paper_id string")
    got = vi.search(index, queries, 5, probes=len(index.centroids))
    want = set()
    for paper in "ab":
        want |= brute([r[:2] for r in clustered[:800] if r[2] == paper], [(q, v) for q, v, p in asked[:-2] if p == paper], 5)
    assert pairs(got) == want
    exact = rt.dense_topk(spark.createDataFrame(clustered[:800], SCHEMA), queries.where("query_id < 7000"), 5, scope=["paper_id"])
    assert vi.recall(got, exact).agg({"recall": "min"}).first()[0] == 1.0


def test_nothing_to_index(spark):
    with pytest.raises(ValueError):
        vi.build_index(spark.createDataFrame([(1, None, "a")], SCHEMA), scratch_path(spark, "vectors"))
