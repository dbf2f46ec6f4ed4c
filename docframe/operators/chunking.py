"""Section-aware parent and child chunks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.functions.text import solid_runs, token_count
from docframe.operators.ordered import (
    first_per_key,
    in_order,
    join_in_order,
    number_runs,
    scan,
    sql,
    top_per_key,
)
from docframe.operators.packing import blank_tokens, cut_windows, measured, pack_groups, split_text
from docframe.session import materialize

__all__ = ["ChunkingConfig", "blank_tokens", "chunk", "split_text"]


@dataclass(frozen=True)
class ChunkingConfig:
    parent_max_tokens: int = 1800
    child_max_tokens: int = 450
    overlap_tokens: int = 55
    # "recursive" splits at SEPARATORS; "fixed" cuts windows of whitespace tokens.
    splitter: str = "recursive"
    # Measure of the recursive splitter; a joined text must not measure more than its parts and
    # separators together (true of characters and of tokenizers that split at blanks).
    length: Callable[[str], int] = blank_tokens


# Tokens of a group's text in one row of ``group_by_section``.
PART_TOKENS = 50_000
PARENT = "parent_passage"
VISUAL_CHUNKS = "('table', 'figure', 'equation')"
COLUMNS = (
    "paper_id", "chunk_id", "chunk_type", "parent_key", "section_path", "page_start", "page_end",
    "content", "token_count", "group_no", "parent_no", "child_no", "element_ranges", "element_id",
    "has_internal_text", "parent_chunk_id",
)


def section_runs(elements: DataFrame, length: Callable[[str], int] = blank_tokens) -> DataFrame:
    """Kept elements with the number of their consecutive run of equal paths, what they measure
    (``n``, ``w``) and what the run's elements before them do (``c``). Runs and sums come from one
    pass, so the texts are moved once."""
    runs = number_runs(
        measured(elements, length), ["paper_id"], "order", "section_path", run="group_no", start="group_start", sums={"upto": "n"}
    )
    return runs.withColumn("c", F.col("upto") - F.col("n")).drop("upto")


def group_by_section(elements: DataFrame, part_tokens: int = PART_TOKENS) -> DataFrame:
    """Consecutive runs of kept elements with the same path (K1).

    A run's text is its non-empty texts joined by blank lines, in rows of one shape whatever
    its size: ``part`` counts rows of about ``part_tokens`` tokens, which joined by blank lines
    are the text. Each carries the pages of the whole run and its own elements' orders.
    """
    placed = section_runs(elements).selectExpr("*", f"c DIV {part_tokens} AS part")
    return sql(
        f"""
        WITH parts AS (
          SELECT paper_id, group_no, part, first(section_path) AS section_path,
            btrim({join_in_order('order', "nullif(text, '')", r"'\n\n'")}) AS text,
            min(order) AS first_order, max(order) AS last_order, count(*) AS n_elements
          FROM {{p}} GROUP BY paper_id, group_no, part),
        pages AS (
          SELECT paper_id, group_no, page_start, page_end, explode(sequence(0L, last_part)) AS part
          FROM (SELECT paper_id, group_no, min(page) AS page_start, max(page) AS page_end,
            max(part) AS last_part FROM {{p}} GROUP BY paper_id, group_no))
        SELECT paper_id, group_no, part, section_path, text, page_start, page_end, first_order, last_order, n_elements
        FROM parts JOIN pages USING (paper_id, group_no, part)
        WHERE text <> ''
        """,
        p=placed,
    )


def _splitter(limit: int, overlap: int, kind: str, column: str, length: Callable[[str], int]) -> F.Column:
    if kind == "fixed":
        toks = solid_runs(column)
        return F.expr(
            f"""transform(array({toks}), t -> transform(
                  sequence(0, greatest(size(t) - {overlap} - 1, 0), {limit - overlap}),
                  s -> array_join(slice(t, s + 1, {limit}), ' ')))[0]"""
        )

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t, limit, overlap, length=length))

    return cut(F.col(column))


def split_parents(
    elements: DataFrame, max_tokens: int = 1800, overlap: int = 0, splitter: str = "recursive",
    length: Callable[[str], int] = blank_tokens,
) -> DataFrame:
    """Parent passages of kept elements, numbered over the whole paper (K2). Each inherits its
    section run's pages and path and names the orders of the elements it holds."""
    measure = blank_tokens if splitter == "fixed" else length
    runs = materialize(section_runs(elements, measure).select("paper_id", "group_no", "order", "text", "page", "section_path", "n", "w", "c"))
    texts = runs.select("paper_id", "group_no", "order", "text", "n", "w", "c")
    # The numbering below reads the pieces twice: windows without their texts, which follow from counts
    # alone; others are written once.
    cut = cut_windows(texts, max_tokens, overlap) if splitter == "fixed" else materialize(pack_groups(texts, max_tokens, overlap, length))
    counted = sql(
        """
        SELECT paper_id, group_no, section_path, page_start, page_end, n, last_block
        FROM (SELECT paper_id, group_no, count(*) AS n, max(block) AS last_block FROM {c} GROUP BY paper_id, group_no)
        JOIN (SELECT paper_id, group_no, first(section_path) AS section_path, min(page) AS page_start, max(page) AS page_end
          FROM {r} GROUP BY paper_id, group_no) USING (paper_id, group_no)
        """,
        c=cut.select("paper_id", "group_no", "block"),
        r=runs.select("paper_id", "group_no", "section_path", "page"),
    )
    # A large run's facts are laid out by block, so that its passages do not all meet one row.
    facts = scan(counted, ["paper_id"], "group_no", sums={"upto": "n"}).selectExpr(
        "paper_id", "group_no", "section_path", "page_start", "page_end", "upto - n AS before", "explode(sequence(0L, last_block)) AS block"
    )
    return cut.join(facts, ["paper_id", "group_no", "block"]).selectExpr(
        "paper_id", "group_no", "section_path", "page_start", "page_end", "ranges AS element_ranges",
        "before + no + 1 AS parent_no", "format_string('parent_%04d', before + no + 1) AS parent_key", "content",
    )


def split_children(
    parents: DataFrame, max_tokens: int = 450, overlap: int = 55, splitter: str = "recursive",
    length: Callable[[str], int] = blank_tokens,
) -> DataFrame:
    """Child chunks inside each parent, carrying its key (K3)."""
    cut = parents.withColumn("pieces", _splitter(max_tokens, overlap, splitter, "content", length)).drop("content")
    return cut.selectExpr("*", "posexplode(pieces) AS (pos, content)").selectExpr(
        "paper_id", "group_no", "section_path", "page_start", "page_end", "element_ranges", "parent_no", "parent_key",
        "CAST(pos + 1 AS BIGINT) AS child_no", "content",
    )


def visual_chunks(visuals: DataFrame) -> DataFrame:
    """One chunk per table, figure and formula (K5). Text inside a figure is only flagged."""
    kind = "IF(type = 'formula', 'equation', type)"
    body = (
        "btrim(array_join(filter(array(caption, docling_text, array_join(surrounding_text, ' ')), "
        "p -> coalesce(p, '') <> ''), '\\n'), ' \\n\\t\\r')"
    )
    content = f"IF({body} = '' AND internal_texts = 0, concat({kind}, ' on page ', coalesce(page, 'None')), {body})"
    return visuals.selectExpr(
        "paper_id", f"{kind} AS chunk_type", "section_path", "page AS page_start", "page AS page_end",
        f"{content} AS content", "element_id",
        "internal_texts > 0 AS has_internal_text",
    )


def chunk(elements: DataFrame, visuals: DataFrame, config: ChunkingConfig | None = None) -> DataFrame:
    """Parents, children and visual chunks of all papers, with repeatable ids (K1-K5). A child is given
    its parent's id where it is cut, so that no text is moved to link them."""
    cfg = config or ChunkingConfig()
    parents = split_parents(elements, cfg.parent_max_tokens, 0, cfg.splitter, cfg.length)
    children = split_children(parents, cfg.child_max_tokens, cfg.overlap_tokens, cfg.splitter, cfg.length)
    nothing = "CAST(NULL AS STRING) AS element_id", "false AS has_internal_text"
    rows = (
        parents.selectExpr("*", f"'{PARENT}' AS chunk_type", "CAST(NULL AS BIGINT) AS child_no", *nothing)
        .unionByName(children.selectExpr("*", "'text' AS chunk_type", *nothing))
        .unionByName(visual_chunks(visuals), allowMissingColumns=True)
    )
    ordinal = "coalesce(element_id, concat_ws('.', parent_no, child_no))"
    parent = f"sha2(concat_ws('|', paper_id, '{PARENT}', concat_ws('.', parent_no)), 256)"
    return rows.selectExpr(
        "*", f"sha2(concat_ws('|', paper_id, chunk_type, {ordinal}), 256) AS chunk_id",
        f"IF(chunk_type = 'text', {parent}, NULL) AS parent_chunk_id",
        f"{token_count('content')} AS token_count",
    ).select(*COLUMNS)


def chunk_metrics(chunks: DataFrame, orphans: DataFrame | None = None) -> DataFrame:
    """Counts and token sizes per paper (K6)."""
    out = chunks.groupBy("paper_id").agg(
        F.expr(f"count_if(chunk_type = '{PARENT}') AS parent_count"),
        F.expr(f"count_if(chunk_type <> '{PARENT}') AS child_count"),
        F.expr("count(*) AS total_chunks"),
        F.expr("round(avg(token_count), 2) AS avg_tokens"),
        F.expr("min(token_count) AS min_tokens"),
        F.expr("max(token_count) AS max_tokens"),
        F.expr(f"count_if(chunk_type IN {VISUAL_CHUNKS}) AS visual_chunks"),
        F.expr("coalesce(max(group_no), 0) AS section_groups"),
    )
    if orphans is None:
        return out
    lost = orphans.groupBy("paper_id").agg(F.expr("count(*) AS __n"))
    return out.join(lost, "paper_id", "left").selectExpr(
        *out.columns, "coalesce(__n, 0) AS orphaned_text_elements"
    )


def orphaned_elements(elements: DataFrame, chunks: DataFrame) -> DataFrame:
    """Kept elements that no parent covers (K7). Ranges open and close along the orders of a
    paper; an element where none is open is left over. No range is spelled out."""
    marks = sql(
        f"""
        SELECT paper_id, order, sum(delta) AS delta, max(element_id) AS element_id, max(present) AS present FROM (
          SELECT paper_id, CAST(order AS BIGINT) AS order, 0L AS delta, element_id, true AS present FROM {{e}}
          UNION ALL SELECT paper_id, r.first, 1L, NULL, NULL FROM {{r}}
          UNION ALL SELECT paper_id, r.last + 1, -1L, NULL, NULL FROM {{r}}) GROUP BY paper_id, order
        """,
        e=elements.select("paper_id", "order", "element_id"),
        r=chunks.filter(f"chunk_type = '{PARENT}'").selectExpr("paper_id", "inline(element_ranges) AS (first, last)").selectExpr(
            "paper_id", "named_struct('first', first, 'last', last) AS r"),
    )
    return scan(marks, ["paper_id"], "order", sums={"open": "delta"}).where("present AND open = 0").select("paper_id", "element_id", "order")


def orphan_sample(orphans: DataFrame, n: int = 10) -> DataFrame:
    """First orphaned ids per paper (K7)."""
    return (
        top_per_key(orphans, ["paper_id"], n, "order").groupBy("paper_id")
        .agg(F.expr(f"{in_order('order', 'element_id')} AS orphaned_ids_sample"))
    )


def link_parents(chunks: DataFrame) -> DataFrame:
    """Parent key of a child replaced by the parent's stored id; visuals have none (K8). Rows of
    ``chunk`` have that id already; others are looked up."""
    if "parent_chunk_id" in chunks.columns:
        return chunks
    parents = chunks.filter(f"chunk_type = '{PARENT}'").selectExpr("paper_id", "parent_key", "chunk_id AS parent_chunk_id")
    children = chunks.filter(f"chunk_type <> '{PARENT}'").join(parents, ["paper_id", "parent_key"], "left")
    heads = chunks.filter(f"chunk_type = '{PARENT}'").withColumn("parent_chunk_id", F.lit(None).cast("string"))
    return heads.unionByName(children)


def chunk_report(chunks: DataFrame, n: int = 20) -> tuple[DataFrame, DataFrame]:
    """First parents of each paper, and chunk counts per type (K9)."""
    parents = top_per_key(chunks.filter(f"chunk_type = '{PARENT}'"), ["paper_id"], n, "parent_no").selectExpr(
        "paper_id", "parent_no", "section_path", "page_start", "page_end", "token_count", "length(content) AS chars"
    )
    counts = chunks.filter(f"chunk_type <> '{PARENT}'").groupBy("paper_id", "chunk_type").agg(F.expr("count(*) AS n"))
    return parents, counts


def list_chunks(chunks: DataFrame) -> DataFrame:
    """Listing with a 240-character preview."""
    has = "embedding IS NOT NULL AND size(embedding) > 0" if "embedding" in chunks.columns else "false"
    return chunks.selectExpr(
        "paper_id", "chunk_id", "chunk_type", "section_path", "page_start", "page_end", "token_count",
        f"{has} AS has_embedding", "left(content, 240) AS preview",
    )


def assign_section_ids(elements: DataFrame, sections: DataFrame) -> DataFrame:
    """Id of the first section whose heading ends the element's path.

    The last heading on the path is always that of the header the element stands
    under, so the lookup runs between sections, and elements join on their header.
    """
    firsts = first_per_key(sections, ["paper_id", "heading"], "order_index").selectExpr(
        "paper_id", "heading", "section_id AS first_id"
    )
    lookup = sections.join(firsts, ["paper_id", "heading"]).selectExpr(
        "paper_id", "header_order", "first_id AS section_id"
    )
    return elements.join(lookup, ["paper_id", "header_order"], "left").select(*elements.columns, "section_id")
