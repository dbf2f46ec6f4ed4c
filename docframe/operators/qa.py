"""Extractive question answering with page citations (Q1-Q9).

Everything after retrieval is bounded by the number of results per question.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from docframe.functions.text import overlap_of_sets, split_sentences, word_set
from docframe.operators.ordered import in_order, join_in_order, sql, top_per_key
from docframe.operators.retrieval import retrieve

# Limits, thresholds and messages of the extractive answer.
EVIDENCE_CHARS = 1200
RANK_WEIGHT = 0.05
MIN_SCORE = 0.15
BEST_SENTENCES = 3
HIGH, MEDIUM = 0.55, 0.35
VISUAL = "('table', 'figure', 'equation')"
REFUSAL = (
    "I do not have sufficient grounded evidence in the retrieved passages "
    "to answer this question. "
)
NO_CHUNKS = "No relevant chunks were retrieved."
NO_OVERLAP = "Retrieved chunks did not contain overlapping answer content."
EXTRACTIVE_NOTES = (
    "Extractive mode: answer sentences are taken from retrieved evidence only.",
    "LLM synthesis is optional and disabled unless configured later.",
)
PAGE = "coalesce(nullif(page_start, 0), page_end)"


def score_evidence(results: DataFrame, questions: DataFrame) -> DataFrame:
    """Sentences of the evidence above the threshold, with their score (Q3).

    Order key for equal scores: rank of the chunk, then position of the sentence.
    """
    asked = questions.selectExpr("query_id", f"{word_set('query')} AS asked")
    sentences = results.selectExpr(
        "query_id", "rank", "citation", "score AS rank_score",
        f"posexplode({split_sentences(f'left(content, {EVIDENCE_CHARS})')}) AS (pos, sentence)",
    )
    return (
        sentences.join(asked, "query_id")
        .selectExpr("query_id", "rank", "pos", "citation", "sentence", "asked", f"{word_set('sentence')} AS said", "rank_score")
        .selectExpr(
            "query_id", "rank", "pos", "citation", "sentence",
            f"{overlap_of_sets('asked', 'said')} + {RANK_WEIGHT}D * rank_score AS score",
        )
        .filter(f"score > {MIN_SCORE}D")
    )


def best_sentences(scored: DataFrame, n: int = BEST_SENTENCES) -> DataFrame:
    return top_per_key(scored, ["query_id"], n, "score DESC, rank, pos", rank="place")


def answer_confidence(top_score: str, sentences: str) -> str:
    """high / medium / low by the best score and the number of sentences (Q4)."""
    return f"CASE WHEN {top_score} >= {HIGH}D AND {sentences} >= 2 THEN 'high' WHEN {top_score} >= {MEDIUM}D THEN 'medium' ELSE 'low' END"


def gather_evidence(results: DataFrame) -> DataFrame:
    """Citations, evidence, pages, chunks and visual ids per question (Q5)."""
    columns = results.columns
    visual = "element_id" if "element_id" in columns else "CAST(NULL AS STRING)"
    citation = f"named_struct('label', citation, 'paper_id', paper_id, 'chunk_id', chunk_id, 'page', {PAGE}, 'section_path', section_path, 'chunk_type', chunk_type)"
    item = (
        f"named_struct('chunk_id', chunk_id, 'text', left(content, {EVIDENCE_CHARS}), 'citation', citation, "
        "'page_start', page_start, 'page_end', page_end, 'section_path', section_path, 'chunk_type', chunk_type, 'score', score)"
    )
    return sql(
        f"""
        SELECT query_id, {in_order('rank', citation)} AS citations, {in_order('rank', item)} AS evidence,
          array_sort(collect_set({PAGE})) AS pages, {in_order('rank', 'chunk_id')} AS used_chunks,
          filter({in_order('rank', f"IF(chunk_type IN {VISUAL}, {visual}, NULL)")}, v -> v IS NOT NULL) AS used_visual_elements
        FROM {{r}} GROUP BY query_id
        """,
        r=results,
    )


def assemble_answers(results: DataFrame, questions: DataFrame) -> DataFrame:
    """One answer row per question from retrieved results (Q3-Q6)."""
    body = join_in_order("place", "concat(sentence, ' ', citation)", "' '")
    notes = ", ".join(f"'{n}'" for n in EXTRACTIVE_NOTES)
    none = "CAST(array() AS array<string>)"
    return sql(
        f"""
        WITH told AS (
          SELECT query_id, {body} AS body, max(score) AS top_score, count(*) AS n FROM {{best}} GROUP BY query_id),
        facts AS (
          SELECT q.*, e.citations, e.evidence, e.pages, e.used_chunks, e.used_visual_elements, t.body, t.top_score, t.n,
            CASE WHEN e.query_id IS NULL THEN '{NO_CHUNKS}' WHEN t.query_id IS NULL THEN '{NO_OVERLAP}' END AS gap
          FROM {{q}} q LEFT JOIN {{e}} e ON q.query_id = e.query_id LEFT JOIN told t ON q.query_id = t.query_id)
        SELECT {', '.join(questions.columns)}, coalesce(body, concat('{REFUSAL}', gap)) AS answer,
          IF(gap IS NULL, {answer_confidence('top_score', 'n')}, 'insufficient') AS confidence,
          IF(gap IS NULL, array({notes}), array(gap)) AS limitations,
          IF(gap IS NULL, citations, NULL) AS citations,
          IF(gap IS NULL, evidence, NULL) AS evidence,
          IF(gap IS NULL, pages, array()) AS pages,
          IF(gap IS NULL, used_chunks, {none}) AS used_chunks,
          IF(gap IS NULL, used_visual_elements, {none}) AS used_visual_elements
        FROM facts
        """,
        best=best_sentences(score_evidence(results, questions)),
        e=gather_evidence(results),
        q=questions,
    )


def answer(corpus: DataFrame, questions: DataFrame, top_k: int = 6, **retrieval) -> DataFrame:
    """Cited answer for every (paper, question) row: ``query_id, paper_id, query`` (Q7)."""
    options = {"scope": ["paper_id"], "with_parents": False} | retrieval
    return assemble_answers(retrieve(corpus, questions, top_k=top_k, **options), questions)


def validate_citations(syntheses: DataFrame, evidence: DataFrame) -> DataFrame:
    """Check generated answers against their evidence (Q8).

    Syntheses: ``query_id, answer, confidence, used_citation_labels``; evidence: retrieved
    results. Unknown labels are dropped, an answer without any valid label is rejected
    unless it declares itself insufficient, and kept labels missing from the text are
    appended. Of several chunks with one label the last ranked counts. Citations, evidence,
    chunks and pages are those of the kept labels; visual elements are kept if a kept chunk
    is visual.
    """
    facts = gather_evidence(evidence)
    last = "element_at(filter(g.citations, c -> c.label = l), -1)"
    return sql(
        f"""
        WITH checked AS (
          SELECT s.*, g.citations AS every, g.evidence AS shown, g.used_visual_elements AS visuals,
            transform(filter(array_distinct(s.used_citation_labels), l -> coalesce(exists(g.citations, c -> c.label = l), false)), l -> {last}) AS kept
          FROM {{s}} s LEFT JOIN {{g}} g ON s.query_id = g.query_id)
        SELECT query_id, kept.label AS used_citation_labels, confidence,
          aggregate(filter(kept.label, l -> NOT contains(trim(answer), l)), trim(answer), (a, l) -> trim(concat(a, ' ', l))) AS answer,
          kept AS citations, filter(shown, e -> array_contains(kept.chunk_id, e.chunk_id)) AS evidence,
          kept.chunk_id AS used_chunks, array_sort(array_distinct(filter(kept.page, p -> p IS NOT NULL))) AS pages,
          IF(exists(kept, c -> c.chunk_type IN {VISUAL}), visuals, CAST(array() AS array<string>)) AS used_visual_elements,
          confidence <> 'insufficient' AND size(kept) = 0 AS rejected
        FROM checked
        """,
        g=facts,
        s=syntheses,
    )


def prompt_context(results: DataFrame) -> DataFrame:
    """Label, newline, content; joined by blank lines per question (Q9)."""
    return sql(
        f"""
        SELECT query_id, {join_in_order('rank', "concat(citation, '\\n', content)", "'\\n\\n'")} AS context
        FROM {{r}} GROUP BY query_id
        """,
        r=results,
    )
