"""Element cleaning and document structure.

Input rows: ``paper_id, order, self_ref, parent_ref, page, tree_level,
element_type, label, level, content_layer, text, bbox, page_width``, one per
parsed element; ``order`` is the element's integer position in its paper.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.functions.text import lit, strip
from docframe.operators.ordered import first_per_key, join_in_order, number_rows, scan, sql

# Element types, labels, thresholds and reasons of the cleaning rules.
VISUAL_TYPES = "('TableItem', 'PictureItem', 'FormulaItem')"
HEADER_TYPES = "('SectionHeaderItem', 'TitleItem')"
HEADER_LABELS = "('section_header', 'title')"
FURNITURE_LABELS = "('page_header', 'page_footer', 'furniture')"
MARGIN_LEFT = 40.0
MARGIN_RIGHT_SHARE = 0.92
FAR_RIGHT = 500.0
NARROW_BOX = 30.0
AUDIT_COLUMNS = (
    "element_id", "order", "self_ref", "parent_ref", "page", "tree_level", "element_type",
    "label", "content_layer", "section_path", "text", "text_length", "bounding_box",
    "coordinate_origin", "inside_picture", "keep_for_text", "exclusion_reason",
)

# Element orders per block of section paths and picture references, and blocks per folded block of blocks.
LEAF_ROWS = 512
FAN_IN = 4096
# Element orders per assembled part of a long document.
PART_ROWS = 50_000

IS_HEADER = f"(element_type IN {HEADER_TYPES} OR coalesce(label IN {HEADER_LABELS}, false))"
# A level of 0 and an empty heading count as missing.
HEADING = f"coalesce(nullif({strip('text')}, ''), nullif(label, ''), 'section')"
LEVEL = (
    "coalesce(nullif(CAST(level AS INT), 0), IF(label = 'title', 1, NULL), "
    "nullif(CAST(tree_level AS INT), 0), 1)"
)


def element_id(order: str = "order") -> str:
    return f"format_string('el_%04d', CAST({order} AS BIGINT))"


def number_elements(df: DataFrame, position: str = "position") -> DataFrame:
    """1-based order by an integer position, element ids and per-type visual ids."""
    kinds = {"TableItem": "table", "PictureItem": "figure", "FormulaItem": "formula"}
    counters = {"order": "1L"}
    counters |= {f"__n_{name}": f"CAST(element_type = '{item}' AS BIGINT)" for item, name in kinds.items()}
    visual = " ".join(
        f"WHEN '{item}' THEN format_string('{name}_%03d', __n_{name})" for item, name in kinds.items()
    )
    return scan(df, ["paper_id"], position, sums=counters).selectExpr(
        *df.columns, "order", f"{element_id()} AS element_id", f"CASE element_type {visual} END AS visual_id"
    )


# Parts into which the elements under one parent are dealt; each meets its own copy of the picture row.
SALTS = 32


def _blocked(df: DataFrame) -> DataFrame:
    """Rows with the block of their order. What is looked up by (paper, block) meets rows that
    carry the block where they lie, however often."""
    return df if "__blk" in df.columns else df.selectExpr("*", f"order DIV {LEAF_ROWS} AS __blk")


def _pictures(df: DataFrame) -> DataFrame:
    return (
        df.filter("self_ref IS NOT NULL AND contains(lower(element_type), 'picture')")
        .selectExpr("paper_id", "self_ref AS parent_ref", "true AS __pic")
        .distinct()
    )


def picture_references(df: DataFrame) -> DataFrame:
    """References to pictures in each block of a paper. A parent with any share of the elements
    has one row a block, and no text is moved."""
    used = _blocked(df).filter("parent_ref IS NOT NULL").select("paper_id", "__blk", "parent_ref").distinct()
    return used.join(_pictures(df), ["paper_id", "parent_ref"]).groupBy("paper_id", "__blk").agg(F.collect_set("parent_ref").alias("__refs"))


def flag_inside_picture(df: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """True when the parent element is a picture (C4). Only picture rows are joined, one per
    (paper, reference), copied ``SALTS`` times: a parent with any share of the elements is
    spread over that many keys. With the ``picture_references`` of the elements, those of each
    row's block are looked up instead, in the exchange that other lookups by block need as well."""
    if references is not None:
        return _blocked(df).join(references, ["paper_id", "__blk"], "left").selectExpr(
            *df.columns, "coalesce(array_contains(__refs, parent_ref), false) AS inside_picture"
        )
    pictures = _pictures(df).selectExpr("*", f"explode(sequence(0, {SALTS - 1})) AS __salt")
    salted = df.selectExpr("*", f"CAST(pmod(order, {SALTS}) AS INT) AS __salt")
    return salted.join(pictures, ["paper_id", "parent_ref", "__salt"], "left").selectExpr(
        *df.columns, "coalesce(__pic, false) AS inside_picture"
    )


def is_margin_line_number(text: str, bbox: str, page_width: str) -> str:
    """Isolated 1-4 digit number at the page margin."""
    return (
        rf"({strip(text)} RLIKE r'(?U)^\d{{1,4}}$' AND {bbox} IS NOT NULL AND coalesce("
        f"{bbox}.l <= {MARGIN_LEFT} OR (coalesce({page_width}, 0) <> 0 AND {bbox}.r >= {page_width} * {MARGIN_RIGHT_SHARE}D) "
        f"OR ({bbox}.l > {FAR_RIGHT} AND {bbox}.r - {bbox}.l < {NARROW_BOX}), false))"
    )


def duplicate_headers(df: DataFrame) -> DataFrame:
    """Flag the second and later equal page headers of a paper.

    The first occurrences come from a partial aggregate and are joined back on the
    unique (paper, order), so a repeated header never gathers in one task.
    """
    header = "coalesce(label = 'page_header' AND text <> '', false)"
    firsts = (
        df.filter(header)
        .groupBy("paper_id", "text")
        .agg(F.min("order").alias("order"))
        .selectExpr("paper_id", "order", "true AS __first")
    )
    return df.join(firsts, ["paper_id", "order"], "left").selectExpr(
        *df.columns, f"{header} AND __first IS NULL AS duplicate_header"
    )


def exclusion_reason(duplicate: str | None = None) -> str:
    """First matching reason to leave an element out of the text, else null.

    ``duplicate`` puts the repeated-header rule before the label rule, where it can
    take effect; without it the label rule already removes every page header.
    """
    early = f"WHEN {duplicate} THEN 'duplicate_header'" if duplicate else ""
    return f"""CASE WHEN element_type IN {VISUAL_TYPES} THEN 'visual_element' {early}
        WHEN label IN {FURNITURE_LABELS} THEN concat('label:', label)
        WHEN coalesce(text, '') = '' THEN 'empty_text'
        WHEN inside_picture THEN 'inside_picture'
        WHEN {is_margin_line_number('text', 'bbox', 'page_width')} THEN 'margin_line_number'
        WHEN text = '\\ufeff' THEN 'parser_artifact' END"""


def classify_keep(df: DataFrame, flag_duplicates: bool = False) -> DataFrame:
    """Add ``keep_for_text`` and ``exclusion_reason`` (C6); needs ``inside_picture``."""
    columns = df.columns
    if flag_duplicates:
        df = duplicate_headers(df)
    reason = exclusion_reason("duplicate_header" if flag_duplicates else None)
    return df.selectExpr(*columns, f"{reason} AS exclusion_reason").selectExpr(
        *columns, "exclusion_reason IS NULL AS keep_for_text", "exclusion_reason"
    )


def header_rows(df: DataFrame) -> DataFrame:
    """Headers with heading and level after their fallbacks."""
    return df.filter(IS_HEADER).selectExpr(
        "paper_id", "order", "page", "element_type", "label", f"{HEADING} AS heading", f"{LEVEL} AS level"
    )


_OPEN = "array<struct<level:int,heading:string>>"
_STATE = f"struct<low:int,at:bigint,open:{_OPEN}>"
_EMPTY = f"CAST(named_struct('low', 2147483647, 'at', CAST(NULL AS BIGINT), 'open', array()) AS {_STATE})"


def _then(a: str, b: str) -> str:
    """Open headings after part ``a`` then ``b``: the later part closes every earlier
    entry whose level is not below the lowest level it contains."""
    return (
        f"CAST(named_struct('low', least({a}.low, {b}.low), 'at', coalesce({b}.at, {a}.at), "
        f"'open', concat(filter({a}.open, e -> e.level < {b}.low), {b}.open)) AS {_STATE})"
    )


def _carried(rows: DataFrame, levels: int) -> DataFrame:
    """For rows (paper_id, idx, st) give ``carry``: the combined state of all earlier rows."""
    step = f"array<struct<idx:bigint,carry:{_STATE}>>"
    blk = f"idx DIV {FAN_IN}" if levels else "0L"
    blocks = rows.groupBy("paper_id", F.expr(blk).alias("blk")).agg(
        F.expr("array_sort(collect_list(named_struct('idx', idx, 'st', st))) AS items")
    )
    start = _EMPTY
    if levels:
        totals = blocks.selectExpr(
            "paper_id", "blk AS idx", f"aggregate(items, {_EMPTY}, (a, r) -> {_then('a', 'r.st')}) AS st"
        )
        upper = _carried(totals, levels - 1).withColumnRenamed("idx", "blk")
        blocks, start = blocks.join(upper, ["paper_id", "blk"]), "carry"
    return blocks.selectExpr(
        "paper_id",
        f"""inline(aggregate(items, named_struct('cur', {start}, 'out', CAST(array() AS {step})),
          (a, r) -> named_struct('cur', {_then('a.cur', 'r.st')},
            'out', CAST(concat(a.out, array(named_struct('idx', r.idx, 'carry', a.cur))) AS {step})),
          a -> a.out))""",
    )


def section_marks(df: DataFrame, levels: int = 1) -> DataFrame:
    """Paths that hold in each block of a paper, with the order where each begins."""
    header = f"named_struct('at', CAST(order AS BIGINT), 'level', {LEVEL}, 'heading', {HEADING})"
    single = "named_struct('low', h.level, 'at', h.at, 'open', array(named_struct('level', h.level, 'heading', h.heading)))"
    entry = "array<struct<at:bigint,path:array<string>>>"
    blocks = _blocked(df).groupBy("paper_id", "__blk").agg(
        F.expr(f"array_sort(collect_list(IF({IS_HEADER}, {header}, NULL))) AS heads")
    )
    totals = blocks.selectExpr(
        "paper_id", "__blk AS idx", f"aggregate(heads, {_EMPTY}, (a, h) -> {_then('a', single)}) AS st"
    )
    carry = _carried(totals, levels).withColumnRenamed("idx", "__blk")
    entry_of = "named_struct('at', {s}.at, 'path', {s}.open.heading)"
    return blocks.join(carry, ["paper_id", "__blk"]).selectExpr(
        "paper_id",
        "__blk",
        f"""aggregate(heads, named_struct('cur', carry, 'out', CAST(array({entry_of.format(s='carry')}) AS {entry})),
          (a, h) -> named_struct('cur', {_then('a.cur', single)},
            'out', CAST(concat(a.out, array({entry_of.format(s=_then('a.cur', single))})) AS {entry})),
          a -> a.out) AS __marks""",
    )


def section_path(df: DataFrame, levels: int = 1, marks: DataFrame | None = None) -> DataFrame:
    """Add ``section_path`` (open headings, outermost first) and ``header_order``, the
    order of the header the element stands under (null before the first) (C8).

    Opening and closing headings is an associative operation on (lowest level, open
    headings). Headers are folded inside blocks of a fixed span of the order column,
    block states are folded again ``levels`` times, and the state before each block is
    handed back; elements meet their block's ``section_marks`` (of ``df`` if not given) on
    (paper, block), so no task ever holds a whole document.
    """
    base = [c for c in df.columns if c not in ("section_path", "header_order")]
    placed = _blocked(df).join(section_marks(df, levels) if marks is None else marks, ["paper_id", "__blk"], "left")
    found = "element_at(filter(__marks, m -> coalesce(m.at, -1) <= order), -1)"
    return placed.selectExpr(*base, f"{found} AS __m").selectExpr(
        *base, "__m.path AS section_path", "__m.at AS header_order"
    )


def audit_elements(df: DataFrame, flag_duplicates: bool = False) -> DataFrame:
    """The 17 audit columns per element plus the columns later steps need (C20)."""
    rest = [c for c in df.columns if c != "text"]
    cleaned = df.selectExpr(*rest, f"{strip('`text`')} AS text0").selectExpr(
        *rest, "coalesce(text0, '') AS text"
    )
    # Both lookups are made from the elements alone and met in one exchange of the rows with their texts.
    marks, refs = section_marks(cleaned), picture_references(cleaned)
    located = section_path(classify_keep(flag_inside_picture(_blocked(cleaned), refs), flag_duplicates), marks=marks)
    return located.selectExpr(
        "paper_id",
        f"{element_id()} AS element_id",
        "CAST(order AS BIGINT) AS order",
        "self_ref",
        "parent_ref",
        "page",
        "coalesce(CAST(tree_level AS INT), 0) AS tree_level",
        "element_type",
        "label",
        "coalesce(content_layer, '') AS content_layer",
        "section_path",
        "text",
        "length(text) AS text_length",
        "IF(bbox IS NULL, NULL, named_struct('l', bbox.l, 't', bbox.t, 'r', bbox.r, 'b', bbox.b)) AS bounding_box",
        "bbox.coord_origin AS coordinate_origin",
        "inside_picture",
        "keep_for_text",
        "exclusion_reason",
        "header_order",
        "level",
    )


def kept_elements(audit: DataFrame) -> DataFrame:
    """Elements that form the paper's text."""
    return audit.filter("keep_for_text").selectExpr(
        "paper_id", "element_id", "order", "page", "section_path", "header_order", "element_type AS type",
        "label", "text", "bounding_box", "coordinate_origin", "self_ref AS source_ref",
    )


def build_sections(df: DataFrame) -> DataFrame:
    """One row per header with its page range and element range.

    Element ids are consecutive, so ``first_order``/``last_order`` with ``n_elements``
    name them all without gathering a section in one row; ``section_elements`` lists
    them. ``page_end`` is the latest page seen, not the highest.
    """
    slim = df.select("paper_id", "order", "page", "element_type", "label", "level", "tree_level", "text")
    return sql(
        f"""
        SELECT h.paper_id, format_string('section_%03d', h.section_no) AS section_id,
          h.section_no - 1 AS order_index, h.heading, h.level, h.page AS page_start, s.page_end,
          h.order AS header_order, s.first_order, s.last_order, s.n_elements
        FROM {{headers}} h JOIN (
          SELECT paper_id, header_order, max_by(page, IF(page IS NULL, NULL, order)) AS page_end,
            min(order) AS first_order, max(order) AS last_order, count(*) AS n_elements
          FROM {{placed}} WHERE header_order IS NOT NULL GROUP BY 1, 2) s
        ON h.paper_id = s.paper_id AND h.order = s.header_order
        """,
        headers=number_rows(header_rows(df), ["paper_id"], "order", "section_no"),
        placed=section_path(slim),
    )


def section_elements(audit: DataFrame, sections: DataFrame) -> DataFrame:
    """Membership of elements in sections, one row per element."""
    ids = sections.select("paper_id", "header_order", "section_id")
    return audit.join(ids, ["paper_id", "header_order"]).select("paper_id", "section_id", "element_id", "order")


def infer_title(df: DataFrame) -> DataFrame:
    """First title or level-1 header per paper, with its confidence."""
    titled = "(element_type = 'TitleItem' OR coalesce(label = 'title', false))"
    found = first_per_key(header_rows(df).filter(f"{titled} OR level = 1"), ["paper_id"], "order")
    named = found.selectExpr(
        "paper_id", "heading AS title", f"IF({titled}, 'medium', 'low') AS title_confidence"
    )
    return (
        df.select("paper_id").distinct().join(named, "paper_id", "left")
        .selectExpr("paper_id", "title", "coalesce(title_confidence, 'unknown') AS title_confidence")
    )


def extract_references(elements: DataFrame, heading: str = "reference") -> DataFrame:
    """Kept texts under a heading that starts with "reference" (C11)."""
    return elements.filter(f"startswith(lower(try_element_at(section_path, -1)), {lit(heading)})").select(
        "paper_id", "order", "text"
    )


def cleaning_statistics(audit: DataFrame) -> DataFrame:
    """Totals per paper."""
    return audit.groupBy("paper_id").agg(
        F.count(F.lit(1)).alias("total_elements"),
        F.expr("count_if(keep_for_text) AS kept_for_text"),
        F.expr("count_if(NOT keep_for_text) AS excluded"),
        F.expr("count_if(order = header_order) AS section_count"),
        F.expr("count_if(keep_for_text) AS text_element_count"),
    )


def exclusion_counts(audit: DataFrame) -> DataFrame:
    """Excluded elements per paper and reason."""
    return audit.filter("NOT keep_for_text").groupBy("paper_id", "exclusion_reason").agg(F.expr("count(*) AS n"))


def element_counts(df: DataFrame) -> DataFrame:
    """Counts by item type, by label and by page in one pass."""
    return (
        df.selectExpr(
            "paper_id",
            "stack(3, 'type', element_type, 'label', label, 'page', CAST(page AS STRING)) AS (facet, value)",
        )
        .filter("value IS NOT NULL")
        .groupBy("paper_id", "facet", "value")
        .agg(F.expr("count(*) AS n"))
    )


def markdown_pieces(elements: DataFrame, titles: DataFrame) -> DataFrame:
    """Markdown of each kept element in order: heading line on a change to a non-empty
    path, then the text; the title is piece 0 (C14)."""
    # The current heading changes only on a non-empty path, so empty ones are looked through.
    seen = scan(elements, ["paper_id"], "order", before={"__prev": "IF(size(section_path) > 0, section_path, NULL)"})
    body = seen.selectExpr(
        "paper_id",
        "CAST(order AS BIGINT) AS order",
        """concat(IF(size(section_path) > 0 AND NOT (section_path <=> __prev),
             concat(repeat('#', least(size(section_path) + 1, 6)), ' ', try_element_at(section_path, -1), '\\n\\n'), ''),
           text, '\\n\\n') AS piece""",
    )
    # Every paper has a piece 0, so one without any kept text has its (empty) Markdown.
    head = titles.selectExpr("paper_id", "0L AS order", "IF(title <> '', concat('# ', title, '\\n\\n'), '') AS piece")
    return head.unionByName(body.where("piece IS NOT NULL")).selectExpr("paper_id", "order", "coalesce(piece, '') AS piece")


def render_markdown(elements: DataFrame, titles: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Markdown per paper (C14), one row per ``part_rows`` element orders; a paper below
    that size is exactly one row, stripped and closed by a newline. Parts of a longer one
    concatenate to its text."""
    parts = markdown_pieces(elements, titles).groupBy(
        "paper_id", F.expr(f"order DIV {part_rows} AS part")
    ).agg(F.expr(f"{join_in_order('order', 'piece', repr(''))} AS md"))
    return sql(
        r"""
        SELECT paper_id, part, CASE WHEN part = hi THEN concat(rtrim(' \n\t\r', t), '\n') ELSE t END AS markdown
        FROM (SELECT p.paper_id, p.part, e.hi, IF(p.part = e.lo, ltrim(' \n\t\r', p.md), p.md) AS t
          FROM {p} p JOIN (SELECT paper_id, min(part) AS lo, max(part) AS hi FROM {p} GROUP BY 1) e
            ON p.paper_id = e.paper_id)
        """,
        p=parts,
    )


def filter_elements(
    df: DataFrame,
    *,
    type: str | None = None,
    page: int | None = None,
    section: str | None = None,
    kept_only: bool = False,
) -> DataFrame:
    """Type ignoring case, exact page, section substring ignoring case."""
    column = "type" if "type" in df.columns else "element_type"
    if type is not None:
        df = df.filter(F.lower(column) == type.lower())
    if page is not None:
        df = df.filter(F.col("page") == page)
    if section is not None:
        df = df.filter(f"contains(lower(array_join(section_path, ' > ')), {lit(section.lower())})")
    if kept_only:
        df = df.filter("keep_for_text")
    return df


def validate_parse(reports: DataFrame) -> DataFrame:
    """Accept or reject a parse, with reason and ordered distinct warnings."""
    none = "CAST(array() AS array<string>)"
    facts = reports.selectExpr(
        "*",
        "coalesce(status, 'None') AS __st",
        f"coalesce(errors, {none}) AS __er",
        "coalesce(processed_pages, 0) AS __pp",
        "coalesce(document_pages, 0) AS __dp",
    )
    reason = """CASE
        WHEN exists(__er, e -> contains(lower(e), 'bad_alloc')) THEN concat('Native allocation failure: ',
          element_at(filter(__er, e -> contains(lower(e), 'bad_alloc')), 1))
        WHEN endswith(__st, 'FAILURE') THEN coalesce(nullif(array_join(__er, '; '), ''), 'Conversion FAILURE')
        WHEN endswith(__st, 'PARTIAL_SUCCESS')
          THEN coalesce(nullif(array_join(__er, '; '), ''), 'Conversion PARTIAL_SUCCESS')
        WHEN NOT coalesce(has_document, false) THEN 'Missing document'
        WHEN __pp = 0 AND __dp = 0 THEN 'Empty conversion output'
        WHEN expected_pages IS NOT NULL AND __pp <> 0 AND __pp < expected_pages
          THEN format_string('Processed pages %d < expected PDF pages %d', __pp, expected_pages) END"""
    warnings = """array_distinct(array_compact(concat(
        array(IF(expected_pages IS NOT NULL AND __dp <> 0 AND __dp < expected_pages,
          format_string('Document page count %d differs from PDF page count %d', __dp, expected_pages), NULL)),
        __er,
        array(IF(NOT endswith(__st, 'SUCCESS'), concat('Unexpected conversion status: ', __st), NULL)))))"""
    return facts.selectExpr("*", f"{reason} AS reason").selectExpr(
        *reports.columns, "reason", "reason IS NULL AS accepted",
        f"IF(reason IS NULL, {warnings}, {none}) AS warnings",
    )


def merge_warnings(*stages: str) -> str:
    """Warnings of all stages, distinct, in order of first appearance."""
    return f"array_distinct(array_compact(concat({', '.join(stages)})))"


def needs_ocr(
    page_text: DataFrame, *, min_chars: int = 200, pages: int = 3, mode: str = "auto"
) -> DataFrame:
    """True when the first pages carry too little text (C17); mode "on"/"off" overrides."""
    chars = page_text.groupBy("paper_id").agg(
        F.expr(f"coalesce(sum(IF(page <= {pages}, length(text), 0)), 0) AS chars")
    )
    verdict = str(mode == "on").lower() if mode in ("on", "off") else f"chars < {min_chars}"
    return chars.selectExpr("*", f"{verdict} AS needs_ocr")
