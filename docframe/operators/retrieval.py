"""Lexical, vector and fused retrieval.

Corpus rows: ``chunk_id, paper_id, content, chunk_type, section_path, page_start,
page_end, parent_chunk_id``. Query rows: ``query_id, query`` and, when the search is
confined (to a paper, an owner), the confining column under the same name on both
sides, given as ``scope``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.functions.text import normalize_query
from docframe.operators.lexical import K1, MAX_BUCKETS, B, LexicalIndex, scope_key, scratch_index, search
from docframe.operators.ordered import sql, top_per_key
from docframe.sources.bucketed import open_bucketed, write_bucketed

# Ensemble weights, fusion constant and pool sizes.
WEIGHTS = {"sparse": 0.45, "dense": 0.55}
RRF_CONSTANT = 60
POOL = 40
PREVIEW_CHARS = 500
# Chunks in a bucket of a stored corpus.
BUCKET_ROWS = 50_000
# Vectors per side of a scoring tile.
TILE = 4096


def scope_corpus(
    chunks: DataFrame, papers: DataFrame | None = None, user_id: str | None = None, paper_id: str | None = None
) -> DataFrame:
    """Chunks of the owner's papers, optionally of one paper (R1). The filter comes before
    any ranking, so a search always gets its full number of results."""
    if paper_id is not None:
        chunks = chunks.filter(F.col("paper_id") == paper_id)
    if user_id is not None:
        owned = papers.filter(F.col("user_id") == user_id).select("paper_id")
        chunks = chunks.join(owned, "paper_id", "left_semi")
    return chunks


def _scoped(df: DataFrame, scope: Sequence[str], *exprs: str) -> DataFrame:
    return df.selectExpr(f"{scope_key(scope)} AS scope", *exprs)


def store_corpus(corpus: DataFrame, path: str) -> DataFrame:
    """Write the corpus in buckets of ``chunk_id``, so that the winners of a search are fetched
    where their texts lie; one file a bucket, of about ``BUCKET_ROWS`` rows. Returns it as read."""
    buckets = min(max(8, -(-corpus.count() // BUCKET_ROWS)), MAX_BUCKETS)
    write_bucketed(corpus.repartition(buckets, "chunk_id"), path, ["chunk_id"], buckets)
    schema = ", ".join(f"`{name}` {kind}" for name, kind in corpus.dtypes)
    return open_bucketed(corpus.sparkSession, path, schema, ["chunk_id"], buckets)


def bm25(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = POOL,
    *,
    scope: Sequence[str] = (),
    index: LexicalIndex | None = None,
    k1: float = K1,
    b: float = B,
    pad_unmatched: bool = False,
) -> DataFrame:
    """Top ``k`` chunks per query by BM25 over the scope's documents (R2).

    With a stored ``index`` (built for the same scope columns, which also fixes k1 and b) the
    corpus itself is not read; without one an index is written to the scratch folder first.
    """
    if index is None:
        index = scratch_index(corpus, scope, k1, b)
    elif index.scope != tuple(scope):
        raise ValueError(f"the index is for searches confined by {index.scope}, not {tuple(scope)}")
    ranked = search(index, queries, k)
    if not pad_unmatched:
        return ranked
    # At most k of the first 2k chunks of a scope can be matched already.
    spare = top_per_key(_scoped(corpus, scope, "chunk_id"), ["scope"], 2 * k, "chunk_id")
    fill = (
        _scoped(queries, scope, "query_id").join(spare, "scope")
        .join(ranked, ["query_id", "chunk_id"], "left_anti")
        .selectExpr("query_id", "chunk_id", "0D AS score")
    )
    every = ranked.drop("rank").unionByName(fill)
    return top_per_key(every, ["query_id"], k, "score DESC, chunk_id", rank="rank")


def _tile_scores(k: int):
    def unit(vectors: pd.Series) -> np.ndarray:
        m = np.stack([np.asarray(v, dtype="float64") for v in vectors])
        norms = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(norms == 0, 1.0, norms)

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "chunk_id": [], "score": []})
        left = left.sort_values("chunk_id", ignore_index=True)
        sims = np.round(unit(right["embedding"]) @ unit(left["embedding"]).T, 10)
        keep = min(k, sims.shape[1])
        # Every vector that ties with the k-th is a candidate; the stable sort then prefers low ids.
        floor = np.partition(sims, -keep, axis=1)[:, -keep]
        rows = []
        for i, query in enumerate(right["query_id"]):
            at = np.flatnonzero(sims[i] >= floor[i])
            best = at[np.argsort(-sims[i, at], kind="stable")[:keep]]
            rows.append(pd.DataFrame({"query_id": query, "chunk_id": left["chunk_id"].to_numpy()[best], "score": sims[i, best]}))
        return pd.concat(rows, ignore_index=True)

    return score


def dense_topk(
    corpus: DataFrame, queries: DataFrame, k: int = POOL, *, scope: Sequence[str] = (), tile: int = TILE
) -> DataFrame:
    """Exact top ``k`` chunks per query by cosine similarity.

    Both sides of a scope are cut into tiles of about ``tile`` vectors, as many as the
    scope's size asks for. A task multiplies one tile of queries with one of chunks and
    passes on k rows per query, so neither side is gathered and no pair is written out.
    """
    have = _scoped(corpus, scope, "chunk_id", "embedding")
    want = _scoped(queries, scope, "query_id", "embedding")
    grid = sql(
        f"""
        SELECT c.scope, CAST(ceil(c.n / {tile}) AS INT) AS cn, CAST(ceil(q.n / {tile}) AS INT) AS qn
        FROM (SELECT scope, count(*) AS n FROM {{h}} GROUP BY scope) c
        JOIN (SELECT scope, count(*) AS n FROM {{w}} GROUP BY scope) q USING (scope)
        """,
        h=have,
        w=want,
    )
    left = have.join(grid, "scope").selectExpr(
        "scope", "chunk_id", "embedding", "CAST(pmod(xxhash64(chunk_id), cn) AS INT) AS ct", "explode(sequence(0, qn - 1)) AS qt"
    )
    right = want.join(grid, "scope").selectExpr(
        "scope", "query_id", "embedding", "CAST(pmod(xxhash64(query_id), qn) AS INT) AS qt", "explode(sequence(0, cn - 1)) AS ct"
    )
    keys = ["scope", "ct", "qt"]
    types = dict(want.dtypes)["query_id"], dict(have.dtypes)["chunk_id"]
    scored = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        _tile_scores(k), f"query_id {types[0]}, chunk_id {types[1]}, score double"
    )
    return top_per_key(scored, ["query_id"], k, "score DESC, chunk_id", rank="rank")


def mmr_topk(
    corpus: DataFrame,
    queries: DataFrame,
    k: int,
    *,
    fetch_k: int = POOL,
    balance: float = 0.5,
    scope: Sequence[str] = (),
) -> DataFrame:
    """Diversified vector search (R4): of the ``fetch_k`` nearest, repeatedly take the one
    with the best ``balance * similarity - (1 - balance) * nearest chosen``."""
    near = dense_topk(corpus, queries, fetch_k, scope=scope)
    pool = near.join(corpus.select("chunk_id", "embedding"), "chunk_id").select(
        "query_id", "chunk_id", "score", "embedding"
    )

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "chunk_id"], ascending=[False, True], ignore_index=True)
        m = np.stack([np.asarray(v, dtype="float64") for v in pdf["embedding"]])
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        own = pdf["score"].to_numpy()
        left, taken = list(range(len(pdf))), []
        while left and len(taken) < k:
            if taken:
                closest = (m[left] @ m[taken].T).max(axis=1)
                values = balance * own[left] - (1 - balance) * closest
            else:
                values = own[left]
            taken.append(left.pop(int(np.argmax(np.round(values, 10)))))
        out = pdf.loc[taken, ["query_id", "chunk_id", "score"]]
        return out.assign(rank=range(1, len(taken) + 1))

    types = dict(pool.dtypes)
    return pool.groupBy("query_id").applyInPandas(
        choose, f"query_id {types['query_id']}, chunk_id {types['chunk_id']}, score double, rank int"
    )


def fuse(ranked: dict[str, DataFrame], weights: dict[str, float] | None = None, constant: int = RRF_CONSTANT) -> DataFrame:
    """Weighted reciprocal rank fusion of ranked lists (query_id, chunk_id, rank)."""
    weights = weights or (WEIGHTS if len(ranked) > 1 else dict.fromkeys(ranked, 1.0))
    lists = [
        df.selectExpr("query_id", "chunk_id", f"{weights[name]}D / ({constant} + rank) AS part")
        for name, df in ranked.items()
    ]
    every = lists[0]
    for more in lists[1:]:
        every = every.unionByName(more)
    return every.groupBy("query_id", "chunk_id").agg(F.expr("round(sum(part), 12) AS fused"))


def citation_label(chunk_id: str = "chunk_id") -> str:
    """Citation of a chunk by type, page and section; page 0 counts as missing."""
    page = "coalesce(nullif(page_start, 0), nullif(page_end, 0))"
    section = "nullif(array_join(section_path, ' > '), '')"
    visual = " ".join(
        f"WHEN chunk_type = '{kind}' THEN IF({page} IS NULL, '[{name}]', concat('[{name}, Page ', {page}, ']'))"
        for kind, name in (("table", "Table"), ("figure", "Figure"), ("equation", "Equation"))
    )
    return f"""CASE {visual}
        WHEN {page} IS NOT NULL AND {section} IS NOT NULL THEN concat('[Page ', {page}, ', Section ', {section}, ']')
        WHEN {page} IS NOT NULL THEN concat('[Page ', {page}, ']')
        WHEN {section} IS NOT NULL THEN concat('[Section ', {section}, ']')
        ELSE concat('[Chunk ', left({chunk_id}, 8), ']') END"""


def expand_parents(results: DataFrame, corpus: DataFrame) -> DataFrame:
    """Preview and pages of a result's parent, where it is in scope."""
    parents = corpus.selectExpr(
        "chunk_id AS parent_chunk_id", f"left(content, {PREVIEW_CHARS}) AS parent_content_preview",
        "array(page_start, page_end) AS parent_pages",
    )
    return results.join(parents, "parent_chunk_id", "left").select(
        *results.columns, "parent_content_preview", "parent_pages"
    )


def retrieve(
    corpus: DataFrame,
    queries: DataFrame,
    *,
    top_k: int = 8,
    candidate_pool: int = POOL,
    scope: Sequence[str] = (),
    index: LexicalIndex | None = None,
    vectors: DataFrame | None = None,
    use_mmr: bool = False,
    with_parents: bool = True,
) -> DataFrame:
    """Ranked, cited chunks per query.

    ``index`` is a stored lexical index of the corpus for ``scope``. ``vectors`` (query_id,
    embedding) switches the dense half on; the corpus must then carry ``embedding``. Without it
    the lexical list alone decides. Blank queries have no result. Texts are fetched for the
    winners only; from a corpus of ``store_corpus`` without moving any other row.
    """
    queries = queries.filter(f"{normalize_query('query')} <> ''")
    lists = {"sparse": bm25(corpus, queries, candidate_pool, scope=scope, index=index)}
    if vectors is not None:
        probes = queries.join(vectors, "query_id")
        search = mmr_topk if use_mmr else dense_topk
        lists["dense"] = search(corpus, probes, candidate_pool, scope=scope)
    best = top_per_key(fuse(lists), ["query_id"], top_k, "fused DESC, chunk_id", rank="rank")
    columns = ["paper_id", "content", "chunk_type", "section_path", "page_start", "page_end", "parent_chunk_id"]
    # One row per (query, rank) against unique chunk ids.
    found = best.join(corpus.select("chunk_id", *columns), "chunk_id").selectExpr(
        "query_id", "rank", "1D / rank AS score", "chunk_id", *columns, f"{citation_label()} AS citation"
    )
    return expand_parents(found, corpus) if with_parents else found


def diagnostics(results: DataFrame, queries: DataFrame, corpus: DataFrame, *, scope: Sequence[str] = (), use_mmr: bool = False, retriever: str = "bm25") -> DataFrame:
    """Corpus size, returned count and settings per query; empty queries are named."""
    return sql(
        f"""
        SELECT q.query_id, IF(q.clean = '', NULL, coalesce(c.n, 0)) AS corpus_size, coalesce(r.n, 0) AS returned,
          {str(use_mmr).lower()} AS mmr, IF(coalesce(c.n, 0) = 0, 'none', '{retriever}') AS retriever,
          IF(q.clean = '', 'empty_query', NULL) AS error
        FROM {{q}} q LEFT JOIN (SELECT scope, count(*) AS n FROM {{c}} GROUP BY scope) c USING (scope)
        LEFT JOIN (SELECT query_id, count(*) AS n FROM {{r}} GROUP BY query_id) r ON q.query_id = r.query_id
        """,
        q=_scoped(queries, scope, "query_id", f"{normalize_query('query')} AS clean"),
        c=_scoped(corpus, scope, "chunk_id"),
        r=results.select("query_id"),
    )


def hit_ranks(results: DataFrame, cases: DataFrame) -> DataFrame:
    """First rank per case that meets an expected id or substring.

    Cases: ``query_id, expected_chunk_ids, expected_substrings`` (arrays, may be null).
    """
    return sql(
        """
        SELECT c.query_id, min(IF(
            coalesce(array_contains(c.expected_chunk_ids, r.chunk_id), false)
            OR coalesce(exists(c.expected_substrings, s -> contains(lower(r.content), lower(s))), false),
            r.rank, NULL)) AS hit_rank
        FROM {c} c LEFT JOIN {r} r ON c.query_id = r.query_id GROUP BY c.query_id
        """,
        c=cases,
        r=results.select("query_id", "rank", "chunk_id", "content"),
    )


def evaluate_retrieval(results: DataFrame, cases: DataFrame, ks: Sequence[int] = (5, 10)) -> DataFrame:
    """Number of cases, MRR and Recall@k; misses count 0, no cases give 0."""
    recalls = [
        F.expr(f"round(coalesce(avg(IF(hit_rank <= {k}, 1D, 0D)), 0D), 4) AS `recall_at_{k}`") for k in ks
    ]
    return hit_ranks(results, cases).agg(
        F.expr("count(*) AS n_cases"),
        F.expr("round(coalesce(avg(coalesce(1D / hit_rank, 0D)), 0D), 4) AS mrr"),
        *recalls,
    )
