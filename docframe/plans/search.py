"""Queries over retrieval and question answering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.functions import text as tx
from docframe.operators import chunking as ck
from docframe.operators import cleaning as cl
from docframe.operators import index as ix
from docframe.operators import lexical as lx
from docframe.operators import qa
from docframe.operators import retrieval as rt
from docframe.operators import vector_index as vi
from docframe.plans.adapters import elements, stage, stage_folder, table
from docframe.plans.chunks import chunks
from docframe.plans.reference_sql import cte
from docframe.plans.registry import query
from docframe.plans.structure import joined_path

DIM = 64
CITATION_SQL = """CASE
  WHEN chunk_type = 'table' THEN '[Table, Page ' || page_start || ']' WHEN chunk_type = 'figure' THEN '[Figure, Page ' || page_start || ']'
  WHEN chunk_type = 'equation' THEN '[Equation, Page ' || page_start || ']'
  WHEN len(section_path) > 0 THEN '[Page ' || page_start || ', Section ' || array_to_string(section_path, ' > ') || ']'
  ELSE '[Page ' || page_start || ']' END"""


def bm25_sql(corpus: str, queries: str, k: int) -> str:
    """BM25 top k of queries(query_id, scope, query) over corpus(chunk_id, scope, content)."""
    return f"""
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
      WITH tok AS (SELECT scope, chunk_id, len(a) AS dl, unnest(a) AS term FROM (
          SELECT scope, chunk_id, [lower(w) FOR w IN regexp_extract_all(content, '[A-Za-z0-9_]+')] AS a FROM {corpus})),
      tf AS (SELECT scope, chunk_id, dl, term, count(*) AS tf FROM tok GROUP BY ALL),
      sz AS (SELECT scope, count(*) AS n, avg(len(regexp_extract_all(content, '[A-Za-z0-9_]+'))) AS avgdl FROM {corpus} GROUP BY 1),
      df AS (SELECT scope, term, count(*) AS df FROM tf GROUP BY 1, 2),
      qt AS (SELECT query_id, scope, term, count(*) AS qtf FROM (
          SELECT query_id, scope, unnest([lower(w) FOR w IN regexp_extract_all(query, '[A-Za-z0-9_]+')]) AS term FROM {queries}) GROUP BY ALL)
      SELECT query_id, chunk_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5
          / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
      FROM tf JOIN qt USING (scope, term) JOIN df USING (scope, term) JOIN sz USING (scope) GROUP BY 1, 2))
    WHERE rank <= {k}"""


cte("corpus", "chunks", """
    SELECT c.*, p.chunk_id AS parent_chunk_id, CASE WHEN c.chunk_type IN ('table', 'figure', 'equation') THEN c.ordinal END AS element_id
    FROM chunks c LEFT JOIN chunks p ON p.paper_id = c.paper_id AND p.chunk_type = 'parent_passage'
      AND c.chunk_type = 'text' AND p.parent_no = c.parent_no
""")
cte("cited", "corpus", f"SELECT *, {CITATION_SQL} AS citation FROM corpus")
cte("open_corpus", "corpus", "SELECT '' AS scope, chunk_id, content FROM corpus")
cte("open_queries", "", "SELECT item_id AS query_id, '' AS scope, text AS query FROM benchmark")
cte("open_hits", "open_corpus open_queries", bm25_sql("open_corpus", "open_queries", 10))
# Every run of ten words of an item's whole text is a substring to find.
cte("expected_hits", "open_hits corpus", """
    SELECT item_id, h.rank AS hit_rank FROM (SELECT item_id, lower(array_to_string(w[i + 1:least(i + 10, len(w))], ' ')) AS part FROM (
        SELECT item_id, w, unnest(generate_series(0, greatest(len(w) - 10, 0))) AS i FROM (SELECT item_id, regexp_extract_all(text, '\\S+') AS w FROM benchmark)) WHERE len(w) > 0) b
    JOIN open_hits h ON h.query_id = b.item_id JOIN corpus c ON c.chunk_id = h.chunk_id AND contains(lower(c.content), b.part)
""")
cte("paper_corpus", "corpus", "SELECT paper_id AS scope, chunk_id, content FROM corpus")
cte("questions", "titles", """
    SELECT paper_id AS query_id, paper_id, paper_id AS scope, 'What does the paper say about ' || title AS query
    FROM titles WHERE title IS NOT NULL
""")
cte("paper_hits", "paper_corpus questions", bm25_sql("paper_corpus", "questions", 6))
cte("found", "paper_hits cited", "SELECT h.query_id, h.rank, 1.0::DOUBLE / h.rank AS rscore, c.* FROM paper_hits h JOIN cited c USING (chunk_id)")
def answer_ctes(p: str, found: str, asked: str) -> None:
    """Table expressions from retrieved results to answers, named with a prefix."""
    cte(f"{p}sentences", f"{found} {asked}", f"""
        SELECT query_id, rank, pos, citation, sentence, CASE WHEN len(q) = 0 OR len(s) = 0 THEN 0 ELSE
            len(list_intersect(q, s))::DOUBLE / len(q) END + 0.05::DOUBLE * rscore AS score
        FROM (SELECT *, list_distinct([lower(w) FOR w IN regexp_extract_all(query, '[A-Za-z0-9_]+')]) AS q,
            list_distinct([lower(w) FOR w IN regexp_extract_all(sentence, '[A-Za-z0-9_]+')]) AS s
          FROM (SELECT query_id, rank, citation, rscore, unnest(a) AS sentence, generate_subscripts(a, 1) AS pos FROM (
              SELECT *, [trim(x) FOR x IN string_split(regexp_replace(trim(content[1:1200]), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) IF trim(x) <> ''] AS a FROM {found}))
          JOIN (SELECT query_id, query FROM {asked}) USING (query_id))
    """)
    cte(f"{p}scored", f"{p}sentences", f"SELECT * FROM {p}sentences WHERE score > 0.15::DOUBLE")
    cte(f"{p}best", f"{p}scored", f"SELECT * FROM {p}scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, pos) <= 3")
    cte(f"{p}answers", f"{p}best {found} {asked}", f"""
        SELECT q.query_id, q.paper_id, q.query, coalesce(b.body, '{qa.REFUSAL}' || CASE WHEN f.n IS NULL THEN '{qa.NO_CHUNKS}' ELSE '{qa.NO_OVERLAP}' END) AS answer,
          CASE WHEN b.body IS NULL THEN 'insufficient' WHEN top >= 0.55::DOUBLE AND b.n >= 2 THEN 'high' WHEN top >= 0.35::DOUBLE THEN 'medium' ELSE 'low' END AS confidence,
          CASE WHEN b.body IS NULL THEN '' ELSE f.pages END AS pages, CASE WHEN b.body IS NULL THEN '' ELSE f.used_chunks END AS used_chunks,
          CASE WHEN b.body IS NULL THEN '' ELSE f.visuals END AS visuals, CASE WHEN b.body IS NULL THEN 0 ELSE f.n END AS n_citations
        FROM {asked} q LEFT JOIN (
          SELECT query_id, string_agg(sentence || ' ' || citation, ' ' ORDER BY score DESC, rank, pos) AS body, max(score) AS top, count(*) AS n
          FROM {p}best GROUP BY 1) b ON b.query_id = q.query_id
        LEFT JOIN (SELECT query_id, count(*) AS n, array_to_string(list_sort(list_distinct(list(page_start))), ',') AS pages,
            string_agg(chunk_id, ',' ORDER BY rank) AS used_chunks, coalesce(string_agg(element_id, ',' ORDER BY rank), '') AS visuals
          FROM {found} GROUP BY 1) f ON f.query_id = q.query_id
    """)


answer_ctes("", "found", "questions")


# Corpora as this session knows them, by folder.
_CORPORA: dict[str, DataFrame] = {}


def linked(spark, d):
    """Linked chunks, for what reads them once and fetches none by its id."""
    return ck.link_parents(chunks(spark, d))


def corpus(spark, d):
    """Linked chunks, stored in buckets of their ids."""
    def write(path):
        _CORPORA[path] = rt.store_corpus(linked(spark, d), path)

    return _CORPORA[stage_folder(spark, d, "corpus", write)]


def open_index(spark, d):
    """Stored lexical index of all chunks for unconfined searches."""
    return lx.open_index(spark, stage_folder(spark, d, "open_index", lambda p: lx.build_index(corpus(spark, d), p)))


def paper_index(spark, d):
    """Stored lexical index for searches inside one paper."""
    build = lambda p: lx.build_index(corpus(spark, d), p, scope=["paper_id"])
    return lx.open_index(spark, stage_folder(spark, d, "paper_index", build))


def open_queries(spark, d):
    return table(spark, d, "benchmark").selectExpr("item_id AS query_id", "text AS query")


def questions(spark, d):
    named = stage(spark, d, "titles", lambda: cl.infer_title(elements(spark, d)))
    return named.filter("title IS NOT NULL").selectExpr(
        "paper_id AS query_id", "paper_id", "concat('What does the paper say about ', title) AS query"
    )


def with_ids(results, source):
    return results.join(source.select("chunk_id", "element_id"), "chunk_id")


def expected_parts(text: str) -> str:
    """Runs of ten words of a whole text; all of a shorter one."""
    words = tx.solid_runs(text)
    return f"""transform(array({words}), w -> IF(size(w) = 0, CAST(array() AS array<string>), transform(sequence(0, greatest(size(w) - 10, 0)), i -> array_join(slice(w, i + 1, 10), ' '))))[0]"""


def paper_results(spark, d):
    """Stored results of the paper questions, as the answering queries below read them."""
    c = corpus(spark, d)
    return stage(spark, d, "results", lambda: with_ids(
        rt.retrieve(c, questions(spark, d), top_k=6, scope=["paper_id"], index=paper_index(spark, d), with_parents=False), c))


@query("scope_corpus", """
    SELECT c.chunk_id, c.paper_id FROM corpus c JOIN documents d ON CAST(d.doc_id AS VARCHAR) = c.paper_id WHERE d.source = 'src7'
""", uses="corpus")
def _(spark, d):
    papers = table(spark, d, "documents").selectExpr("CAST(doc_id AS STRING) AS paper_id", "source AS user_id")
    return rt.scope_corpus(linked(spark, d), papers, user_id="src7").select("chunk_id", "paper_id")


@query("lexical_index", """
    WITH tf AS (SELECT chunk_id, len(a) AS dl, unnest(a) AS term FROM (
        SELECT chunk_id, [lower(w) FOR w IN regexp_extract_all(content, '[A-Za-z0-9_]+')] AS a FROM corpus)),
    gains AS (SELECT term, tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(len(regexp_extract_all(content, '[A-Za-z0-9_]+'))) FROM corpus))) AS gain
      FROM (SELECT chunk_id, dl, term, count(*) AS tf FROM tf GROUP BY ALL))
    SELECT term, count(*) AS df, round(max(gain), 9) AS top FROM gains GROUP BY 1
""", uses="corpus")
def _(spark, d):
    terms = open_index(spark, d).table(spark, "terms")
    return terms.groupBy("term").agg(F.expr("sum(df) AS df"), F.expr("round(max(top), 9) AS top"))


@query("bm25", "SELECT query_id, chunk_id, score, rank FROM open_hits", uses="open_hits")
def _(spark, d):
    return rt.bm25(corpus(spark, d), open_queries(spark, d), 10, index=open_index(spark, d))


@query("bm25_in_paper", "SELECT query_id, chunk_id, score, rank FROM paper_hits", uses="paper_hits")
def _(spark, d):
    return rt.bm25(corpus(spark, d), questions(spark, d), 6, scope=["paper_id"], index=paper_index(spark, d))


CENTROIDS = """
    SELECT label, list(m ORDER BY i) AS centroid FROM (
      SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM (
        SELECT label, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1"""


def centroids(vectors):
    return (
        vectors.selectExpr("label", "posexplode(embedding) AS (i, x)").groupBy("label", "i")
        .agg(F.expr("avg(CAST(x AS DOUBLE)) AS m")).groupBy("label")
        .agg(F.expr("transform(array_sort(collect_list(named_struct('i', i, 'm', m))), p -> p.m) AS embedding"))
        .withColumnRenamed("label", "query_id")
    )


@query("dense_topk", f"""
    WITH c AS ({CENTROIDS}),
    s AS (SELECT c.label AS query_id, e.vec_id AS chunk_id,
        round(list_cosine_similarity([CAST(x AS DOUBLE) FOR x IN e.embedding], c.centroid), 10) AS score FROM c, embeddings e)
    SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 10
""")
def _(spark, d):
    e = table(spark, d, "embeddings")
    near = rt.dense_topk(e.withColumnRenamed("vec_id", "chunk_id"), centroids(e), 10)
    return near.selectExpr("query_id", "chunk_id", "round(score, 6) AS score", "rank")


def vector_index(spark, d):
    e = table(spark, d, "embeddings").withColumnRenamed("vec_id", "chunk_id")
    return vi.open_index(spark, stage_folder(spark, d, "vector_index", lambda p: vi.build_index(e, p)))


def near_queries(spark, d):
    """Every hundredth vector."""
    return table(spark, d, "embeddings").where("vec_id % 100 = 0").selectExpr("vec_id AS query_id", "embedding")


@query("vector_index_exact", """
    WITH e AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings),
    s AS (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, round(list_cosine_similarity(e.v, q.v), 10) AS score FROM e q, e WHERE q.vec_id % 100 = 0)
    SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 10
""")
def _(spark, d):
    # All cells: what the index ranks is exact.
    index = vector_index(spark, d)
    near = vi.search(index, near_queries(spark, d), 10, probes=len(index.centroids))
    return near.selectExpr("query_id", "chunk_id", "round(score, 6) AS score", "rank")


@query("vector_index", """
    SELECT count(*) AS n_queries, 10 * count(*) AS n_found, true AS recall_reached, true AS fewer_rows_read FROM embeddings WHERE vec_id % 100 = 0
""")
def _(spark, d):
    index, q = vector_index(spark, d), near_queries(spark, d)
    e = table(spark, d, "embeddings").withColumnRenamed("vec_id", "chunk_id")
    found = vi.search(index, q, 10)
    share = vi.recall(found, rt.dense_topk(e, q, 10)).agg(F.avg("recall").alias("r"), F.count("*").alias("n_queries"))
    pairs = vi.probed(index, q).join(index.cells(spark).groupBy("cell").agg(F.count("*").alias("n")), "cell")
    read = pairs.agg(F.sum("n").alias("read"))
    # One row each.
    facts = share.join(read).join(e.agg(F.count("*").alias("n"))).join(found.agg(F.count("*").alias("n_found")))
    return facts.selectExpr("n_queries", "n_found", "r >= 0.9 AS recall_reached", "read < n * n_queries AS fewer_rows_read")


@query("mmr_topk", f"""
    WITH RECURSIVE c AS ({CENTROIDS}),
    e AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings),
    near AS (SELECT * FROM (SELECT c.label AS query_id, e.vec_id, e.v, round(list_cosine_similarity(e.v, c.centroid), 10) AS score FROM c, e)
      QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20),
    pick AS (
      SELECT query_id, 1 AS step, [vec_id] AS ids, [v] AS vs, vec_id, score FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM near) WHERE rn = 1
      UNION ALL
      SELECT query_id, step + 1, list_append(ids, vec_id), list_append(vs, v), vec_id, score FROM (
        SELECT p.query_id, p.step, p.ids, p.vs, n.vec_id, n.v, n.score, row_number() OVER (PARTITION BY p.query_id ORDER BY
            round(0.5 * n.score - 0.5 * list_max([list_cosine_similarity(n.v, x) FOR x IN p.vs]), 10) DESC, n.score DESC, n.vec_id) AS rn
        FROM pick p JOIN near n ON n.query_id = p.query_id AND NOT list_contains(p.ids, n.vec_id) WHERE p.step < 5) WHERE rn = 1)
    SELECT query_id, vec_id AS chunk_id, round(score, 6) AS score, step AS rank FROM pick
""")
def _(spark, d):
    e = table(spark, d, "embeddings")
    got = rt.mmr_topk(e.withColumnRenamed("vec_id", "chunk_id"), centroids(e), 5, fetch_k=20)
    return got.selectExpr("query_id", "chunk_id", "round(score, 6) AS score", "rank")


EMBED_SQL = f"""
    SELECT chunk_id, slot, w / sqrt(sum(w * w) OVER (PARTITION BY chunk_id)) AS x FROM (
      SELECT chunk_id, CAST('0x' || md5(term)[1:8] AS BIGINT) % {DIM} AS slot,
        sum(CASE WHEN md5(term)[9] < '8' THEN 1.0 ELSE -1.0 END) AS w
      FROM (SELECT chunk_id, unnest([lower(w) FOR w IN regexp_extract_all(content, '[A-Za-z0-9_]+')]) AS term FROM corpus)
      GROUP BY 1, 2) WHERE w <> 0"""


def embedded(spark, d):
    return stage(spark, d, "embedded", lambda: ix.embed(corpus(spark, d), ix.hashing_model(DIM)))


@query("embed", f"SELECT chunk_id, slot, round(x, 4) AS value FROM ({EMBED_SQL}) WHERE x <> 0", uses="corpus")
def _(spark, d):
    v = ix.embed(linked(spark, d).select("chunk_id", "content"), ix.hashing_model(DIM))
    return v.selectExpr("chunk_id", "posexplode(embedding) AS (slot, x)").filter("x <> 0").selectExpr(
        "chunk_id", "slot", "round(CAST(x AS DOUBLE), 4) AS value"
    )


FUSED = """
    SELECT query_id, chunk_id, round(sum(part), 12) AS fused FROM (
      SELECT query_id, chunk_id, 0.45 / (60 + rank) AS part FROM open_hits
      UNION ALL SELECT query_id, chunk_id, 0.55 / (60 + rank) FROM (
        SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id DESC) AS rank FROM open_hits))
    GROUP BY 1, 2"""


@query("fuse", f"SELECT query_id, chunk_id, round(fused, 9) AS fused FROM ({FUSED})", uses="open_hits")
def _(spark, d):
    sparse = rt.bm25(corpus(spark, d), open_queries(spark, d), 10, index=open_index(spark, d))
    reverse = sparse.selectExpr(
        "query_id", "chunk_id", "row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id DESC) AS rank"
    )
    return rt.fuse({"sparse": sparse, "dense": reverse}).selectExpr("query_id", "chunk_id", "round(fused, 9) AS fused")


@query("retrieve", """
    SELECT f.query_id, f.rank, round(f.rscore, 6) AS score, f.chunk_id, f.paper_id, f.citation, f.parent_chunk_id,
      p.content[1:500] AS parent_content_preview
    FROM found f LEFT JOIN corpus p ON p.chunk_id = f.parent_chunk_id
""", uses="found corpus")
def _(spark, d):
    got = rt.retrieve(corpus(spark, d), questions(spark, d), top_k=6, scope=["paper_id"], index=paper_index(spark, d))
    return got.selectExpr(
        "query_id", "rank", "round(score, 6) AS score", "chunk_id", "paper_id", "citation", "parent_chunk_id",
        "parent_content_preview",
    )


@query("retrieve_hybrid")
def _(spark, d):
    q = open_queries(spark, d)
    vectors = ix.embed(q, ix.hashing_model(DIM), column="query").select("query_id", "embedding")
    got = rt.retrieve(embedded(spark, d), q, top_k=8, index=open_index(spark, d), vectors=vectors)
    return got.selectExpr("query_id", "rank", "round(score, 6) AS score", "chunk_id", "citation")


@query("expand_parents", """
    SELECT f.query_id, f.chunk_id, p.content[1:500] AS parent_content_preview, p.page_start AS parent_page_start,
      p.page_end AS parent_page_end
    FROM found f LEFT JOIN corpus p ON p.chunk_id = f.parent_chunk_id
""", uses="found corpus")
def _(spark, d):
    got = rt.expand_parents(paper_results(spark, d), corpus(spark, d))
    return got.selectExpr("query_id", "chunk_id", "parent_content_preview", "parent_pages[0] AS parent_page_start",
                          "parent_pages[1] AS parent_page_end")


@query("citation_label", "SELECT chunk_id, citation FROM cited", uses="cited")
def _(spark, d):
    return linked(spark, d).selectExpr("chunk_id", f"{rt.citation_label()} AS citation")


@query("diagnostics", """
    SELECT q.query_id, (SELECT count(*) FROM corpus c WHERE c.paper_id = q.paper_id) AS corpus_size,
      (SELECT count(*) FROM paper_hits h WHERE h.query_id = q.query_id) AS returned, false AS mmr,
      CASE WHEN EXISTS (SELECT 1 FROM corpus c WHERE c.paper_id = q.paper_id) THEN 'bm25' ELSE 'none' END AS retriever,
      CAST(NULL AS VARCHAR) AS error
    FROM questions q
""", uses="questions corpus paper_hits")
def _(spark, d):
    return rt.diagnostics(paper_results(spark, d), questions(spark, d), corpus(spark, d), scope=["paper_id"])


@query("evaluate_retrieval", """
    WITH hit AS (SELECT item_id, min(hit_rank) AS hit_rank FROM benchmark LEFT JOIN expected_hits USING (item_id) GROUP BY 1)
    SELECT count(*) AS n_cases, round(avg(coalesce(1.0 / hit_rank, 0)), 4) AS mrr,
      round(avg(CASE WHEN hit_rank <= 5 THEN 1.0 ELSE 0 END), 4) AS recall_at_5,
      round(avg(CASE WHEN hit_rank <= 10 THEN 1.0 ELSE 0 END), 4) AS recall_at_10 FROM hit
""", uses="expected_hits")
def _(spark, d):
    q = open_queries(spark, d)
    found = rt.retrieve(corpus(spark, d), q, top_k=10, index=open_index(spark, d), with_parents=False)
    cases = q.selectExpr(
        "query_id", "CAST(NULL AS array<string>) AS expected_chunk_ids", f"{expected_parts('query')} AS expected_substrings"
    )
    return rt.evaluate_retrieval(found, cases)


@query("embedding_backlog", """
    SELECT c.paper_id, count(*) FILTER (coalesce(l.quality, 0) = 0) AS updated,
      count(*) FILTER (l.quality = 1) AS skipped, count(*) AS total
    FROM corpus c LEFT JOIN labels l ON CAST(l.doc_id AS VARCHAR) = c.paper_id GROUP BY 1
""", uses="corpus")
def _(spark, d):
    # Papers of good quality count as embedded already, poor ones under another model.
    state = table(spark, d, "labels").selectExpr(
        "CAST(doc_id AS STRING) AS paper_id", "IF(quality = 1, 'hashing', 'older') AS embedding_model"
    )
    return ix.backlog_summary(ix.embedding_backlog(linked(spark, d).join(state, "paper_id", "left"), "hashing"))


@query("purge_index", """
    SELECT chunk_id FROM corpus WHERE paper_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1)
""", uses="corpus")
def _(spark, d):
    toxic = table(spark, d, "labels").filter("toxic = 1").selectExpr("CAST(doc_id AS STRING) AS paper_id")
    return ix.purge_index(linked(spark, d), toxic).select("chunk_id")


@query("split_sentences", """
    SELECT doc_id, sentence FROM (SELECT doc_id, unnest([trim(x) FOR x IN string_split(
      regexp_replace(trim(text), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) IF trim(x) <> '']) AS sentence FROM documents)
""")
def _(spark, d):
    return table(spark, d, "documents").selectExpr("doc_id", f"explode({tx.split_sentences('text')}) AS sentence")


@query("overlap_score", """
    SELECT conv_id, turn, CASE WHEN len(q) = 0 OR len(s) = 0 THEN 0 ELSE round(len(list_intersect(q, s))::DOUBLE / len(q), 6) END AS score
    FROM (SELECT c.conv_id, c.turn, list_distinct([lower(w) FOR w IN regexp_extract_all(f.text, '[A-Za-z0-9_]+')]) AS q,
        list_distinct([lower(w) FOR w IN regexp_extract_all(c.text, '[A-Za-z0-9_]+')]) AS s
      FROM conversations c JOIN conversations f ON f.conv_id = c.conv_id AND f.turn = 0)
""")
def _(spark, d):
    c = table(spark, d, "conversations")
    first = c.filter("turn = 0").selectExpr("conv_id", "text AS question")
    return c.join(first, "conv_id").selectExpr(
        "conv_id", "turn", f"round({tx.overlap_score('question', 'text')}, 6) AS score"
    )


@query("score_evidence", "SELECT query_id, rank, pos - 1 AS pos, citation, sentence, round(score, 9) AS score FROM scored", uses="scored")
def _(spark, d):
    return qa.score_evidence(paper_results(spark, d), questions(spark, d)).withColumn("score", F.round("score", 9))


@query("answer_confidence", "SELECT query_id, confidence FROM answers", uses="answers")
def _(spark, d):
    return qa.assemble_answers(paper_results(spark, d), questions(spark, d)).select("query_id", "confidence")


@query("gather_evidence", """
    SELECT query_id, count(*) AS n_citations, array_to_string(list_sort(list_distinct(list(page_start))), ',') AS pages,
      string_agg(chunk_id, ',' ORDER BY rank) AS used_chunks, coalesce(string_agg(element_id, ',' ORDER BY rank), '') AS visuals,
      sum(length(content[1:1200])) AS evidence_chars
    FROM found GROUP BY 1
""", uses="found")
def _(spark, d):
    return qa.gather_evidence(paper_results(spark, d)).selectExpr(
        "query_id", "size(citations) AS n_citations", "array_join(pages, ',') AS pages",
        "array_join(used_chunks, ',') AS used_chunks", "array_join(used_visual_elements, ',') AS visuals",
        "aggregate(evidence, 0L, (a, e) -> a + length(e.text)) AS evidence_chars",
    )


@query("insufficient_answers", "SELECT query_id, answer FROM answers WHERE confidence = 'insufficient'", uses="answers")
def _(spark, d):
    got = qa.assemble_answers(paper_results(spark, d), questions(spark, d))
    return got.filter("confidence = 'insufficient'").select("query_id", "answer")


@query("answer", "SELECT * FROM answers", uses="answers")
def _(spark, d):
    c, q = corpus(spark, d), questions(spark, d)
    found = with_ids(rt.retrieve(c, q, top_k=6, scope=["paper_id"], index=paper_index(spark, d), with_parents=False), c)
    return qa.assemble_answers(found, q).selectExpr(
        "query_id", "paper_id", "query", "answer", "confidence", "array_join(pages, ',') AS pages",
        "array_join(used_chunks, ',') AS used_chunks", "array_join(used_visual_elements, ',') AS visuals",
        "coalesce(size(citations), 0) AS n_citations",
    )


@query("validate_citations", """
    WITH lab AS (SELECT query_id, citation, arg_max(chunk_id, rank) AS chunk_id, arg_max(page_start, rank) AS page, arg_max(chunk_type, rank) AS kind FROM found GROUP BY 1, 2),
    top AS (SELECT query_id, citation, content FROM found WHERE rank = 1),
    shown AS (SELECT query_id, string_agg(element_id, ',' ORDER BY rank) AS ids FROM found WHERE element_id IS NOT NULL GROUP BY 1),
    syn AS (SELECT q.query_id, q.query AS answer, t.citation AS label FROM questions q LEFT JOIN top t USING (query_id))
    SELECT s.query_id, CASE WHEN s.label IS NULL THEN s.answer ELSE s.answer || ' ' || s.label END AS answer,
      coalesce(l.chunk_id, '') AS used_chunks, coalesce(CAST(l.page AS VARCHAR), '') AS pages, s.label IS NULL AS rejected,
      CASE WHEN s.label IS NULL THEN '' ELSE s.label || '@' || l.chunk_id END AS citations,
      coalesce(f.content[1:1200], '') AS evidence, CASE WHEN l.kind IN ('table', 'figure', 'equation') THEN coalesce(v.ids, '') ELSE '' END AS visuals
    FROM syn s LEFT JOIN lab l ON l.query_id = s.query_id AND l.citation = s.label
    LEFT JOIN found f ON f.query_id = s.query_id AND f.chunk_id = l.chunk_id LEFT JOIN shown v ON v.query_id = s.query_id
""", uses="found questions")
def _(spark, d):
    found = paper_results(spark, d)
    top = found.filter("rank = 1").select("query_id", "citation")
    drafts = questions(spark, d).join(top, "query_id", "left").selectExpr(
        "query_id", "query AS answer", "'medium' AS confidence",
        "array_compact(array('[Page 999]', citation, citation)) AS used_citation_labels",
    )
    return qa.validate_citations(drafts, found).selectExpr(
        "query_id", "answer", "array_join(used_chunks, ',') AS used_chunks", "array_join(pages, ',') AS pages", "rejected",
        "array_join(transform(citations, c -> concat(c.label, '@', c.chunk_id)), ',') AS citations",
        "coalesce(array_join(evidence.text, ''), '') AS evidence", "coalesce(array_join(used_visual_elements, ','), '') AS visuals",
    )


@query("prompt_context", """
    SELECT query_id, string_agg(citation || chr(10) || content, chr(10) || chr(10) ORDER BY rank) AS context FROM found GROUP BY 1
""", uses="found")
def _(spark, d):
    return qa.prompt_context(paper_results(spark, d))
