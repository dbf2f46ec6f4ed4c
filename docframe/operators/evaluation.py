"""Evaluation data derived from papers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.functions.text import BLANK_RUN, strip
from docframe.operators.ordered import first_per_key, sql, top_per_key
from docframe.operators.retrieval import evaluate_retrieval, hit_ranks, retrieve

# Sizes, wording and the questions no paper can answer.
RETRIEVAL_SEEDS = 30
QA_SEEDS = 25
UNANSWERABLE = (
    "What is the capital of Mars according to this paper?",
    "Who won the 1998 FIFA World Cup according to this paper?",
    "What is the author\\'s phone number?",
    "List unpublished raw patient identifiers from this paper.",
    "What GPU did the authors use on page 999?",
)
# Texts at the head of a paper that any seed can come from.
HEAD_TEXTS = 35


def _head(elements: DataFrame) -> DataFrame:
    """First kept texts of each paper with their position from 1, and how many the paper
    has up to that bound; seeds never look further."""
    top = top_per_key(elements, ["paper_id"], HEAD_TEXTS, "order", rank="place")
    return top.selectExpr(
        "paper_id", "place", "element_id", "page", f"{strip('text')} AS text", "text AS raw",
        "count(*) OVER (PARTITION BY paper_id) AS texts",
    )


def _fill(seeds: DataFrame, head: DataFrame, total: int, kind: str, text: str) -> DataFrame:
    """Top up each paper to ``total`` seeds by cycling through its texts; the next seed
    uses the text at (number so far) modulo the number of texts."""
    counts = head.select("paper_id", "texts").distinct().join(
        seeds.groupBy("paper_id").agg(F.expr("count(*) AS have")), "paper_id", "left"
    ).selectExpr("paper_id", "texts", "coalesce(have, 0) AS have").filter(f"have < {total}")
    slots = counts.selectExpr("paper_id", "texts", f"explode(sequence(have, {total - 1}L)) AS n")
    # Fewer texts than the head bound means all of them are in it, so the cycle is exact;
    # otherwise n is below the bound and the cycle has not yet started.
    return slots.selectExpr("paper_id", "n", "CAST(n % texts AS INT) + 1 AS place").join(head, ["paper_id", "place"]).selectExpr(
        "paper_id", "CAST(n + 1 AS INT) AS position", f"format_string('{kind}-fill-%02d', n + 1) AS id", f"{text} AS question",
        "IF(coalesce(page, 0) = 0, NULL, page) AS expected_page", "element_id AS expected_element_id",
    )


def retrieval_seeds(sections: DataFrame, elements: DataFrame) -> DataFrame:
    """Up to 30 retrieval cases per paper (E1): long section headings, then early passages,
    then any text in turn."""
    heads = sections.filter("order_index < 20").selectExpr(
        "paper_id", f"{strip('heading')} AS heading", "order_index", "page_start"
    ).filter("length(heading) >= 8")
    by_section = heads.selectExpr(
        "paper_id", "order_index AS rank", "format_string('rq-sec-%02d', order_index + 1) AS id",
        "concat(\"What does the paper discuss in section '\", heading, \"'?\") AS question",
        "nullif(page_start, 0) AS expected_page", "CAST(NULL AS STRING) AS expected_element_id",
    )
    head = _head(elements)
    by_passage = head.filter("place > 5 AND length(text) >= 60").selectExpr(
        "paper_id", "1000L + place AS rank", "format_string('rq-pass-%02d', place - 5) AS id",
        f"concat('Find the passage discussing: ', left(regexp_replace(text, {BLANK_RUN}, ' '), 120)) AS question",
        "nullif(page, 0) AS expected_page", "element_id AS expected_element_id",
    )
    seeds = top_per_key(by_section.unionByName(by_passage), ["paper_id"], RETRIEVAL_SEEDS, "rank", rank="position").drop("rank")
    extra = _fill(seeds, head, RETRIEVAL_SEEDS, "rq", "concat('Where is this content: ', left(raw, 80))")
    return seeds.unionByName(extra)


def qa_seeds(papers: DataFrame, sections: DataFrame, visuals: DataFrame, elements: DataFrame) -> DataFrame:
    """Up to 25 questions per paper (E2). Papers: ``paper_id, title, page_count``."""
    none = "CAST(NULL AS STRING) AS expected_element_id"
    page0 = "CAST(NULL AS INT) AS expected_page"
    title = papers.selectExpr("paper_id", "1L AS rank", "'qa-01' AS id", "'What is the title of this paper?' AS question", page0, none,
                              "left(substring_index(coalesce(nullif(title, ''), 'the paper'), ':', 1), 40) AS expected_text")
    pages = papers.selectExpr("paper_id", "2L AS rank", "'qa-02' AS id", "'How many pages does the document have?' AS question", page0, none,
                              "CAST(page_count AS STRING) AS expected_text")
    nothing = "CAST(NULL AS STRING) AS expected_text"
    heads = sections.filter("order_index < 10").selectExpr(
        "paper_id", "3L + order_index AS rank", "format_string('qa-%02d', order_index + 3) AS id",
        "concat(\"Summarize the '\", coalesce(heading, ''), \"' section.\") AS question", "nullif(page_start, 0) AS expected_page", none, nothing,
    )
    firsts = first_per_key(visuals, ["paper_id", "type"], "order")
    # Numbers of visual questions continue after the sections.
    asked = papers.select("paper_id").join(
        sections.filter("order_index < 10").groupBy("paper_id").agg(F.expr("count(*) AS n")), "paper_id", "left"
    ).selectExpr("paper_id", "coalesce(n, 0) AS n")
    pictured = sql(
        """
        SELECT v.paper_id, 100L + v.k AS rank, format_string('qa-%02d', a.n + 2 + row_number() OVER (PARTITION BY v.paper_id ORDER BY v.k)) AS id,
          CASE v.type WHEN 'formula' THEN concat('What formula appears on page ', coalesce(v.page, 'None'), '?')
            WHEN 'table' THEN concat('What table is on page ', coalesce(v.page, 'None'), '?')
            ELSE concat('Describe the figure on page ', coalesce(v.page, 'None'), '.') END AS question,
          v.page AS expected_page, v.element_id AS expected_element_id, CAST(NULL AS STRING) AS expected_text
        FROM (SELECT *, CASE type WHEN 'formula' THEN 1 WHEN 'table' THEN 2 ELSE 3 END AS k FROM {v}) v JOIN {a} a ON a.paper_id = v.paper_id
        """,
        v=firsts,
        a=asked,
    )
    tricky = ", ".join(f"'{q}'" for q in UNANSWERABLE)
    adversarial = papers.selectExpr("paper_id", f"posexplode(array({tricky})) AS (pos, question)").selectExpr(
        "paper_id", "200L + pos AS rank", "format_string('qa-adv-%02d', pos + 1) AS id", "question", page0, none, nothing
    )
    every = title.unionByName(pages).unionByName(heads).unionByName(pictured).unionByName(adversarial)
    seeds = top_per_key(every, ["paper_id"], QA_SEEDS, "rank", rank="position").drop("rank")
    extra = _fill(seeds, _head(elements), QA_SEEDS, "qa", "concat('Explain this statement from the paper: ', left(raw, 100))")
    return seeds.unionByName(extra, allowMissingColumns=True)


def retrieval_report(cases: DataFrame, corpus: DataFrame, ks: Sequence[int] = (5, 10), **options) -> tuple[DataFrame, DataFrame]:
    """Metrics and per-case hit ranks over stored cases."""
    results = retrieve(corpus, cases, top_k=max(ks), with_parents=False, **options)
    return evaluate_retrieval(results, cases, ks), hit_ranks(results, cases)
