"""Queries over comparisons, research reports and evaluation data."""

from __future__ import annotations

from pyspark.sql import functions as F

from docframe.operators import cleaning as cl
from docframe.operators import evaluation as ev
from docframe.operators import research as rs
from docframe.plans.adapters import elements, stage, table
from docframe.plans.chunks import sections, visuals
from docframe.plans.reference_sql import cte
from docframe.plans.registry import query
from docframe.plans.search import answer_ctes, bm25_sql, corpus, expected_parts, open_index, paper_index
from docframe.plans.structure import kept

# A run per source: its question is the first benchmark text of the same number, its papers the source's documents.
cte("papers", "titles", """
    SELECT t.paper_id, t.title, d.source AS user_id, CASE WHEN coalesce(l.quality, 1) = 1 THEN 'completed' ELSE 'failed' END AS status, d.doc_id AS created_at
    FROM titles t JOIN documents d ON CAST(d.doc_id AS VARCHAR) = t.paper_id LEFT JOIN labels l ON l.doc_id = d.doc_id
""")
cte("research_runs", "", """
    SELECT run_id, question, CASE WHEN len(regexp_extract_all(trim(question), '\\S+')) < 4 THEN 'Provide a grounded literature-oriented answer to: ' || trim(question)
      ELSE trim(question) END AS clarified
    FROM (SELECT s.source AS run_id, CASE WHEN s.source = 'src3' THEN ' the and ' ELSE b.text END AS question
      FROM (SELECT DISTINCT source FROM documents) s JOIN benchmark b ON b.item_id = CAST(s.source[4:] AS BIGINT))
""".replace("\\\\S", "\\S"))
cte("chosen", "papers", """
    SELECT user_id AS run_id, paper_id, row_number() OVER (PARTITION BY user_id ORDER BY created_at, paper_id) AS place
    FROM papers WHERE status = 'completed' QUALIFY place <= 3
""")
cte("asked", "chosen research_runs", "SELECT run_id || '/' || paper_id AS query_id, run_id, paper_id, paper_id AS scope, place, clarified AS query FROM chosen JOIN research_runs USING (run_id)")
cte("run_hits", "asked paper_corpus", bm25_sql("paper_corpus", "asked", 4))
cte("run_found", "run_hits cited asked", "SELECT h.query_id, h.rank, 1.0::DOUBLE / h.rank AS rscore, a.run_id, a.place, c.* FROM run_hits h JOIN cited c USING (chunk_id) JOIN asked a ON a.query_id = h.query_id")

answer_ctes("run_", "run_found", "asked")
cte("told", "run_answers asked", "SELECT a.*, q.run_id, q.place FROM run_answers a JOIN asked q USING (query_id)")


def papers(spark, d):
    named = cl.infer_title(elements(spark, d))
    state = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").selectExpr(
        "CAST(doc_id AS STRING) AS paper_id", "source AS user_id", "IF(coalesce(quality, 1) = 1, 'completed', 'failed') AS status",
        "doc_id AS created_at",
    )
    return named.join(state, "paper_id").selectExpr("paper_id", "title", "concat(paper_id, '.pdf') AS filename", "user_id", "status", "created_at")


def research_questions(spark, d):
    sources = table(spark, d, "documents").select("source").distinct()
    texts = table(spark, d, "benchmark").selectExpr("concat('src', item_id) AS source", "text")
    return sources.join(texts, "source").selectExpr(
        "source AS run_id", "source AS user_id", "IF(source = 'src3', ' the and ', text) AS question", "CAST(NULL AS array<string>) AS selected_papers"
    )


def asked(spark, d):
    runs = rs.clarify(research_questions(spark, d))
    return stage(spark, d, "asked", lambda: rs.paper_questions(rs.select_papers(runs, papers(spark, d)), runs))


def run_results(spark, d):
    return stage(spark, d, "run_results", lambda: rs.find(corpus(spark, d), asked(spark, d), index=paper_index(spark, d)))


def run_answers(spark, d):
    return stage(spark, d, "run_answers", lambda: rs.assemble_answers(run_results(spark, d), asked(spark, d)))


@query("clarify", "SELECT run_id, clarified, clarified || ' limitations' AS second FROM research_runs", uses="research_runs")
def _(spark, d):
    return rs.clarify(research_questions(spark, d)).selectExpr("run_id", "clarified", "search_queries[1] AS second")


@query("select_papers", "SELECT run_id, paper_id, place FROM chosen WHERE run_id IN (SELECT run_id FROM research_runs)", uses="chosen research_runs")
def _(spark, d):
    return rs.select_papers(research_questions(spark, d), papers(spark, d))


@query("candidates", """
    SELECT run_id, paper_id, title, 'library' AS origin FROM papers JOIN research_runs ON run_id = user_id WHERE status = 'completed'
    UNION ALL SELECT run_id, NULL, text, 'external' FROM (SELECT r.run_id, d.text, row_number() OVER (PARTITION BY r.run_id ORDER BY doc_id) AS rn
      FROM research_runs r JOIN documents d ON d.source = r.run_id WHERE d.lang = 'en') WHERE rn <= 5
""", uses="papers research_runs")
def _(spark, d):
    external = table(spark, d, "documents").filter("lang = 'en'").selectExpr("source AS run_id", "text AS title", "doc_id AS position")
    got = rs.candidates(research_questions(spark, d), papers(spark, d), external, 5)
    return got.select("run_id", "paper_id", "title", "origin")


@query("collect_evidence", "SELECT run_id, place, rank, paper_id, content[1:500] AS claim, citation, chunk_id, page_start AS page FROM run_found", uses="run_found")
def _(spark, d):
    return rs.collect_evidence(run_results(spark, d), asked(spark, d)).drop("supported")


@query("claims", "SELECT run_id, place, paper_id, answer AS text, confidence, pages FROM told", uses="told")
def _(spark, d):
    return rs.claims(run_answers(spark, d)).selectExpr("run_id", "place", "paper_id", "text", "confidence", "array_join(pages, ',') AS pages")


@query("verify_claims", """
    SELECT run_id, paper_id, used_chunks <> '' AND confidence <> 'insufficient' AS supported,
      CASE WHEN used_chunks = '' THEN 'Rejected claim for ' || paper_id || ': no chunk ids' ELSE '' END AS feedback FROM told
""", uses="told")
def _(spark, d):
    got = rs.verify_claims(rs.claims(run_answers(spark, d)), rs.collect_evidence(run_results(spark, d), asked(spark, d)))
    return got.selectExpr("run_id", "paper_id", "supported", "array_join(feedback, ';') AS feedback")


@query("compare", """
    SELECT run_id, place, paper_id, title, answer AS summary, confidence, pages FROM told LEFT JOIN (SELECT paper_id, title FROM papers) USING (paper_id)
    WHERE run_id IN (SELECT run_id FROM told GROUP BY 1 HAVING count(*) >= 2)
""", uses="told papers")
def _(spark, d):
    found = rs.compare(run_answers(spark, d), titles=papers(spark, d))
    return found.selectExpr("run_id", "place", "paper_id", "title", "summary", "confidence", "array_join(pages, ',') AS pages")


AGREE = """
    WITH w AS (SELECT conv_id, turn, list_distinct([lower(x) FOR x IN regexp_extract_all(text, '\\S+') IF length(x) > 4]) AS words
        FROM conversations WHERE role <> 'system'),
    base AS (SELECT conv_id, min(turn) AS turn FROM w GROUP BY 1)
    SELECT w.conv_id AS run_id, w.turn AS place, len(list_intersect(w.words, b.words)) AS shared,
      CASE WHEN len(list_intersect(w.words, b.words)) >= 5 THEN 'agreement' ELSE 'difference' END AS verdict
    FROM w JOIN base USING (conv_id) JOIN w b ON b.conv_id = base.conv_id AND b.turn = base.turn WHERE w.turn > b.turn"""


def turn_findings(spark, d):
    # Turns of a conversation stand for the papers' summaries, the system's for insufficient ones.
    return table(spark, d, "conversations").selectExpr(
        "conv_id AS run_id", "turn AS place", "concat('p', turn) AS paper_id", "text AS summary", "IF(role = 'system', 'insufficient', 'low') AS confidence")


@query("agreement_pairs", AGREE)
def _(spark, d):
    return rs.agreement_pairs(turn_findings(spark, d)).select("run_id", "place", "shared", "verdict")


@query("uncertainties", """
    SELECT conv_id AS run_id, 'Insufficient evidence in paper p' || turn AS note FROM conversations WHERE role = 'system'
    UNION ALL SELECT conv_id, 'Not enough papers had grounded answers for a firm comparison.' FROM conversations GROUP BY 1 HAVING count(*) FILTER (role <> 'system') < 2
""")
def _(spark, d):
    return rs.uncertainties(turn_findings(spark, d)).select("run_id", "note")


@query("render_report", """
    WITH w AS (SELECT *, list_distinct([lower(x) FOR x IN regexp_extract_all(answer, '\\S+') IF length(x) > 4]) AS words FROM told WHERE confidence <> 'insufficient'),
    base AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY place) = 1),
    notes AS (SELECT w.run_id, CASE WHEN len(list_intersect(w.words, b.words)) >= 5 THEN 1 ELSE 2 END AS kind, w.place, CASE WHEN len(list_intersect(w.words, b.words)) >= 5
        THEN 'Agreement: Papers ' || b.paper_id || ' and ' || w.paper_id || ' share overlapping retrieved terminology related to the question.'
        ELSE 'Difference: Papers ' || b.paper_id || ' and ' || w.paper_id || ' retrieve largely distinct evidence for this question.' END AS note
      FROM w JOIN base b ON b.run_id = w.run_id AND w.place > b.place
      UNION ALL SELECT run_id, 3, place, 'Uncertainty: Insufficient evidence in paper ' || paper_id FROM told WHERE confidence = 'insufficient'
      UNION ALL SELECT run_id, 3, 9, 'Uncertainty: Not enough papers had grounded answers for a firm comparison.' FROM told GROUP BY 1 HAVING count(*) FILTER (confidence <> 'insufficient') < 2),
    nl AS (SELECT chr(10) AS n)
    SELECT r.run_id, '# Research report' || n || n || '**Question:** ' || r.clarified || n || n || '## Supported findings' || coalesce(f.body, '')
      || CASE WHEN c.body IS NULL THEN '' ELSE n || n || '## Comparison notes' || c.body END || CASE WHEN b.body IS NULL THEN '' ELSE n || n || '## Critic feedback' || b.body END
      || n || n || '## Citations' || coalesce(e.body, '') AS report
    FROM research_runs r CROSS JOIN nl
    LEFT JOIN (SELECT run_id, string_agg(chr(10) || '- (' || paper_id || ')' || CASE WHEN pages = '' THEN '' ELSE ' pages=[' || replace(pages, ',', ', ') || ']' END || ' ' || answer, '' ORDER BY place) AS body
      FROM told WHERE confidence <> 'insufficient' GROUP BY 1) f ON f.run_id = r.run_id
    LEFT JOIN (SELECT run_id, string_agg(chr(10) || '- ' || note, '' ORDER BY kind, place) AS body FROM notes GROUP BY 1) c ON c.run_id = r.run_id
    LEFT JOIN (SELECT run_id, string_agg(chr(10) || '- Rejected claim for ' || paper_id || ': no chunk ids', '' ORDER BY place) AS body FROM told WHERE used_chunks = '' GROUP BY 1) b ON b.run_id = r.run_id
    LEFT JOIN (SELECT run_id, string_agg(chr(10) || '- paper=' || paper_id || ' ' || citation || ' chunk=' || chunk_id, '' ORDER BY place, rank) AS body FROM run_found GROUP BY 1) e ON e.run_id = r.run_id
""", uses="told research_runs run_found")
def _(spark, d):
    evidence = rs.collect_evidence(run_results(spark, d), asked(spark, d))
    answers = run_answers(spark, d)
    verified = rs.verify_claims(rs.claims(answers), evidence)
    runs = rs.clarify(research_questions(spark, d))
    return rs.render_report(runs, verified, rs.comparison_notes(rs.compare(answers)), evidence)


@query("run_research", """
    WITH n AS (
      SELECT run_id, 2 AS step, count(*) AS n FROM asked GROUP BY 1
      UNION ALL SELECT run_id, 3, count(*) FROM run_found GROUP BY 1
      UNION ALL SELECT run_id, 4, count(*) FROM asked GROUP BY 1
      UNION ALL SELECT run_id, 5, count(*) FROM asked WHERE place <= 3 GROUP BY 1 HAVING count(*) >= 2
      UNION ALL SELECT run_id, 6, count(*) FROM told WHERE used_chunks <> '' AND confidence <> 'insufficient' GROUP BY 1)
    SELECT run_id, step, ['clarify', 'search_library', 'retrieve', 'analyze_paper', 'compare_papers', 'verify_claims', 'synthesize_report'][step] AS stage,
      CASE WHEN step IN (1, 7) THEN 1 ELSE coalesce(n, 0) END AS n
    FROM (SELECT run_id, unnest(generate_series(1, 7)) AS step FROM research_runs) LEFT JOIN n USING (run_id, step)
""", uses="asked run_found told research_runs")
def _(spark, d):
    return rs.run_research(research_questions(spark, d), papers(spark, d), corpus(spark, d), index=paper_index(spark, d))["trace"]


@query("retrieval_seeds", """
    WITH head AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY ord) AS place, count(*) OVER (PARTITION BY paper_id) AS texts FROM kept),
    every AS (SELECT paper_id, order_index AS rank, printf('rq-sec-%02d', order_index + 1) AS id, 'What does the paper discuss in section ''' || heading || '''?' AS question,
        page_start AS expected_page, NULL AS expected_element_id FROM sections WHERE order_index < 20 AND length(heading) >= 8
      UNION ALL SELECT paper_id, 1000 + place, printf('rq-pass-%02d', place - 5), 'Find the passage discussing: ' || text[1:120], page, printf('el_%04d', ord)
      FROM head WHERE place BETWEEN 6 AND 35 AND length(text) >= 60),
    seeds AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY rank) <= 30),
    have AS (SELECT h.paper_id, h.texts, coalesce(s.n, 0) AS n FROM (SELECT DISTINCT paper_id, texts FROM head) h
      LEFT JOIN (SELECT paper_id, count(*) AS n FROM seeds GROUP BY 1) s USING (paper_id)),
    slots AS (SELECT paper_id, texts, unnest(generate_series(n, 29)) AS i FROM have WHERE n < 30)
    SELECT paper_id, id, question, expected_page, expected_element_id FROM seeds
    UNION ALL SELECT s.paper_id, printf('rq-fill-%02d', i + 1), 'Where is this content: ' || h.text[1:80], h.page, printf('el_%04d', h.ord)
    FROM slots s JOIN head h ON h.paper_id = s.paper_id AND h.place = i % s.texts + 1
""", uses="kept sections")
def _(spark, d):
    return ev.retrieval_seeds(sections(spark, d), kept(spark, d)).select("paper_id", "id", "question", "expected_page", "expected_element_id")


@query("qa_seeds", """
    WITH head AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY ord) AS place, count(*) OVER (PARTITION BY paper_id) AS texts FROM kept),
    nsec AS (SELECT t.paper_id, least(10, count(s.section_id)) AS n FROM titles t LEFT JOIN sections s USING (paper_id) GROUP BY 1),
    firsts AS (SELECT *, CASE kind WHEN 'formula' THEN 1 WHEN 'table' THEN 2 ELSE 3 END AS k FROM vis WHERE visual_id LIKE '%_001'),
    every AS (
      SELECT paper_id, 1 AS rank, 'qa-01' AS id, 'What is the title of this paper?' AS question, NULL AS expected_page, string_split(coalesce(nullif(title, ''), 'the paper'), ':')[1][1:40] AS expected_text FROM titles
      UNION ALL SELECT paper_id, 2, 'qa-02', 'How many pages does the document have?', NULL, CAST(max(page) AS VARCHAR) FROM el GROUP BY 1
      UNION ALL SELECT paper_id, 3 + order_index, printf('qa-%02d', order_index + 3), 'Summarize the ''' || heading || ''' section.', page_start, NULL FROM sections WHERE order_index < 10
      UNION ALL SELECT f.paper_id, 100 + k, printf('qa-%02d', n.n + 2 + row_number() OVER (PARTITION BY f.paper_id ORDER BY k)),
        CASE k WHEN 1 THEN 'What formula appears on page ' || page || '?' WHEN 2 THEN 'What table is on page ' || page || '?' ELSE 'Describe the figure on page ' || page || '.' END, page, NULL
      FROM firsts f JOIN nsec n ON n.paper_id = f.paper_id
      UNION ALL SELECT paper_id, 200 + i, printf('qa-adv-%02d', i), ['What is the capital of Mars according to this paper?', 'Who won the 1998 FIFA World Cup according to this paper?',
        'What is the author''s phone number?', 'List unpublished raw patient identifiers from this paper.', 'What GPU did the authors use on page 999?'][i], NULL, NULL
      FROM titles, generate_series(1, 5) g(i)),
    seeds AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY rank) <= 25),
    have AS (SELECT h.paper_id, h.texts, s.n FROM (SELECT DISTINCT paper_id, texts FROM head) h JOIN (SELECT paper_id, count(*) AS n FROM seeds GROUP BY 1) s USING (paper_id)),
    slots AS (SELECT paper_id, texts, unnest(generate_series(n, 24)) AS i FROM have WHERE n < 25)
    SELECT paper_id, id, question, expected_page, expected_text FROM seeds
    UNION ALL SELECT s.paper_id, printf('qa-fill-%02d', i + 1), 'Explain this statement from the paper: ' || h.text[1:100], h.page, NULL
    FROM slots s JOIN head h ON h.paper_id = s.paper_id AND h.place = i % s.texts + 1
""", uses="kept sections titles vis el")
def _(spark, d):
    e = elements(spark, d)
    p = cl.infer_title(e).join(e.groupBy("paper_id").agg(F.max("page").alias("page_count")), "paper_id")
    return ev.qa_seeds(p, sections(spark, d), visuals(spark, d), kept(spark, d)).select("paper_id", "id", "question", "expected_page", "expected_text")


@query("retrieval_report", """
    SELECT item_id AS query_id, min(hit_rank) AS hit_rank FROM benchmark LEFT JOIN expected_hits USING (item_id) GROUP BY 1
""", uses="expected_hits")
def _(spark, d):
    cases = table(spark, d, "benchmark").selectExpr(
        "item_id AS query_id", "text AS query", "CAST(NULL AS array<string>) AS expected_chunk_ids", f"{expected_parts('text')} AS expected_substrings")
    return ev.retrieval_report(cases, corpus(spark, d), index=open_index(spark, d))[1]
