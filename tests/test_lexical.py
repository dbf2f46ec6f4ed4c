"""Stored lexical index against a plain ranking over all chunks."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from docframe.operators import lexical as lx
from docframe.operators import retrieval as rt
from docframe.session import scratch_path

WORD = re.compile("[A-Za-z0-9_]+")


def plain(chunks, queries, k):
    """Top k by (query, rank): chunks and queries are (id, scope, text)."""
    docs = defaultdict(dict)
    for key, scope, text in chunks:
        docs[scope][key] = Counter(w.lower() for w in WORD.findall(text or ""))
    out = []
    for key, scope, text in queries:
        pool = docs.get(scope, {})
        if not pool:
            continue
        mean = sum(sum(c.values()) for c in pool.values()) / len(pool)
        scores = Counter()
        for term, times in Counter(w.lower() for w in WORD.findall(text)).items():
            df = sum(term in c for c in pool.values())
            for chunk, c in pool.items():
                if term in c:
                    gain = c[term] * 2.5 / (c[term] + 1.5 * (0.25 + 0.75 * sum(c.values()) / mean))
                    scores[chunk] += times * math.log(1 + (len(pool) - df + 0.5) / (df + 0.5)) * gain
        best = sorted(((-round(s, 6), c) for c, s in scores.items()))[:k]
        out += [(key, c, -s, i + 1) for i, (s, c) in enumerate(best)]
    return sorted(out)


def corpus_of(rng, n, scopes):
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    rows = [(f"c{i:04d}", scopes[rng.randrange(len(scopes))], " ".join(rng.choices(vocabulary, weights, k=rng.randrange(1, 30)))) for i in range(n)]
    return rows + [("c9000", scopes[0], ""), ("c9001", scopes[0], None), ("c9002", scopes[-1], "W1 w1, w1"), ("c9003", scopes[0], rows[0][2])]


def found(df):
    return sorted((r.query_id, r.chunk_id, r.score, r.rank) for r in df.collect())


def same(got, want):
    assert [(q, c, r) for q, c, _, r in got] == [(q, c, r) for q, c, _, r in want]
    assert all(math.isclose(a[2], b[2], abs_tol=2e-6) for a, b in zip(got, want))


@pytest.mark.parametrize("block, bucket_tokens", [(2, 500), (5, 2_000_000), (128, 100)])
def test_exact_for_any_block_and_part_size(spark, monkeypatch, block, bucket_tokens):
    monkeypatch.setattr(lx, "BLOCK", block)
    monkeypatch.setattr(lx, "BUCKET_TOKENS", bucket_tokens)
    rng = random.Random(block)
    rows = corpus_of(rng, 400, ["a"])
    asked = [(i, "a", " ".join(rng.choices([f"w{j}" for j in range(64)], k=rng.randrange(1, 9)))) for i in range(25)] + [(99, "a", "  "), (98, "a", "nowhere")]
    corpus = spark.createDataFrame(rows, "chunk_id string, paper_id string, content string")
    queries = spark.createDataFrame([(q, t) for q, _, t in asked], "query_id int, query string")
    index = lx.build_index(corpus, scratch_path(spark, "lexical"))
    assert index.table(spark, "scopes").first().parts > 1 or bucket_tokens > 1000
    for k in (1, 4, 1000):
        same(found(lx.search(index, queries, k)), plain(rows, asked, k))


def test_scopes_are_ranked_by_themselves(spark):
    rng = random.Random(9)
    rows = corpus_of(rng, 300, ["a", "a", "a", "a", "b", "c"])  # two thirds lie in one scope
    asked = [(i, "abcx"[i % 4], " ".join(rng.choices([f"w{j}" for j in range(64)], k=5))) for i in range(20)]
    corpus = spark.createDataFrame(rows, "chunk_id string, paper_id string, content string")
    queries = spark.createDataFrame(asked, "query_id int, paper_id string, query string")
    index = lx.build_index(corpus, scratch_path(spark, "lexical"), scope=["paper_id"])
    same(found(rt.bm25(corpus, queries, 5, scope=["paper_id"], index=index)), plain(rows, asked, 5))
    same(found(rt.bm25(corpus, queries, 5, scope=["paper_id"])), plain(rows, asked, 5))
    with pytest.raises(ValueError):
        rt.bm25(corpus, queries, 5, index=index)


def test_reopened_without_this_sessions_tables(spark):
    from docframe.sources import bucketed

    rows = corpus_of(random.Random(3), 120, ["a"])
    corpus = spark.createDataFrame(rows, "chunk_id string, paper_id string, content string")
    queries = spark.createDataFrame([(1, "w1 w7 w30")], "query_id int, query string")
    index = lx.build_index(corpus, scratch_path(spark, "lexical"))
    want = found(lx.search(index, queries, 6))
    for key in [k for k in bucketed._NAMES if k[1].startswith(index.path)]:
        del bucketed._NAMES[key]
    assert found(lx.search(lx.open_index(spark, index.path), queries, 6)) == want


def test_empty_corpus_and_numeric_ids(spark):
    schema = "chunk_id bigint, content string"
    queries = spark.createDataFrame([(1, "w1")], "query_id int, query string")
    none = lx.build_index(spark.createDataFrame([], schema), scratch_path(spark, "lexical"))
    assert lx.search(none, queries, 3).collect() == []
    some = lx.build_index(spark.createDataFrame([(7, "w1 w2"), (8, "w3")], schema), scratch_path(spark, "lexical"))
    assert [r.chunk_id for r in lx.search(some, queries, 3).collect()] == [7]


def exchanged_scans(plan: str, files: str) -> bool:
    """Whether rows of a scan of ``files`` pass an exchange on the way up (other than of results)."""
    depth = lambda line: len(line) - len(line.lstrip(" :+-|"))
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "FileScan" in line and files in line:
            at, j = depth(line), i
            while j >= 0 and "Aggregate" not in lines[j] and "Join" not in lines[j]:
                if depth(lines[j]) < at and "Exchange" in lines[j]:
                    return True
                at = min(at, depth(lines[j]))
                j -= 1
    return False


def test_winners_are_fetched_without_moving_the_corpus(spark):
    rows = [(f"c{i:03d}", "a", f"w{i % 7} w{i % 5} text", "text", None, 1, 2, "c000") for i in range(300)]
    names = "chunk_id string, paper_id string, content string, chunk_type string, section_path array<string>, page_start int, page_end int, parent_chunk_id string"
    corpus = rt.store_corpus(spark.createDataFrame(rows, names), scratch_path(spark, "corpus"))
    index = lx.build_index(corpus, scratch_path(spark, "lexical"))
    queries = spark.createDataFrame([(1, "w1 w2")], "query_id int, query string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # also when nothing is small
    try:
        got = rt.retrieve(corpus, queries, top_k=3, index=index)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert len(got.collect()) == 3 and got.first().parent_content_preview == "w0 w0 text"
        assert "content" in plan and not exchanged_scans(plan, "content")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_index_of_repeated_and_empty_chunks(spark, tmp_path):
    """Texts without words count for the mean length; rows that repeat a chunk add up their counts, not its length."""
    rows = [("a", "one two"), ("a", "one two"), ("b", "one"), ("c", ""), ("d", None)]
    index = lx.build_index(spark.createDataFrame(rows, "chunk_id string, content string"), f"{tmp_path}/index")
    scope = index.table(spark, "scopes").first()
    assert (scope.n, scope.avgdl) == (5, 1.0)
    got = {r.chunk_id: dict(zip(r.terms, r.gains)) for r in index.table(spark, "forward").collect()}
    gain = lambda tf, dl: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl))
    assert got == {"a": {"one": gain(2, 2), "two": gain(2, 2)}, "b": {"one": gain(1, 1)}}


@pytest.mark.parametrize("scope", [[], ["paper_id"]])
def test_texts_are_dealt_once_with_and_without_scope(spark, tmp_path, monkeypatch, scope):
    plans = {}
    write = lx.write_bucketed

    def watched(df, path, *rest):
        plans[path.rsplit("/", 1)[1]] = df._jdf.queryExecution().executedPlan().toString()
        write(df, path, *rest)

    monkeypatch.setattr(lx, "write_bucketed", watched)
    corpus = spark.createDataFrame(corpus_of(random.Random(5), 50, ["a", "b"]), "chunk_id string, paper_id string, content string")
    lx.build_index(corpus, f"{tmp_path}/index", scope=scope)
    assert {name: plan.count("Exchange hashpartitioning") for name, plan in plans.items()} == {"forward": 1, "blocks": 0, "terms": 0}


def test_search_reads_the_index_where_it_lies(spark, monkeypatch):
    """Also in a session without settings of its own, and when nothing is small."""
    rows = corpus_of(random.Random(4), 200, ["a", "b", "c"])
    corpus = spark.createDataFrame(rows, "chunk_id string, paper_id string, content string")
    index = lx.build_index(corpus, scratch_path(spark, "lexical"), scope=["paper_id"])
    asked = [(1, "a", "w1 w2 w40"), (2, "b", "w3 w3"), (3, "x", "w1")]
    queries = spark.createDataFrame(asked, "query_id int, paper_id string, query string")
    plans = []
    store = lx.materialize

    def watched(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df)

    monkeypatch.setattr(lx, "materialize", watched)
    own = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.requireAllClusterKeysForCoPartition": "true"}
    before = {key: spark.conf.get(key) for key in own}
    try:
        for key, value in own.items():
            spark.conf.set(key, value)
        got = found(lx.search(index, queries, 5))
        assert {key: spark.conf.get(key) for key in own} == own
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    same(got, plain(rows, asked, 5))
    read = [p for p in plans if "spark_catalog" in p]
    assert len(read) == 5 and not any("Bucketed: false" in p for p in read)
