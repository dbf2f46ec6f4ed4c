"""Queries over document elements: cleaning and structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from docframe.functions import text as tx
from docframe.operators import cleaning as cl
from docframe.plans.adapters import elements, stage, table
from docframe.plans.registry import query

def joined_path(sep=" > "):
    return F.array_join("section_path", sep)


def audit(spark, d):
    return stage(spark, d, "audit", lambda: cl.audit_elements(elements(spark, d)))


def kept(spark, d):
    return cl.kept_elements(audit(spark, d))


@query("normalize_query", """
    SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS query FROM benchmark
""")
def _(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.expr(tx.normalize_query("text")).alias("query"))


@query("token_count", """
    SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE greatest(1, len(regexp_extract_all(text, '\\S+'))) END AS tokens
    FROM documents
""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.expr(tx.token_count("text")).alias("tokens"))


@query("number_elements", """
    SELECT paper_id, ord AS "order", printf('el_%04d', ord) AS element_id,
      CASE element_type WHEN 'TableItem' THEN printf('table_%03d', k) WHEN 'PictureItem' THEN printf('figure_%03d', k)
        WHEN 'FormulaItem' THEN printf('formula_%03d', k) END AS visual_id
    FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, element_type ORDER BY ord) AS k FROM el)
""", uses="el")
def _(spark, d):
    src = elements(spark, d).select("paper_id", F.col("order").alias("position"), "element_type")
    return cl.number_elements(src).select("paper_id", "order", "element_id", "visual_id")


@query("flag_inside_picture", """
    SELECT paper_id, ord AS "order", parent_ref <> '#/body' AS inside_picture FROM el
""", uses="el")
def _(spark, d):
    src = elements(spark, d).select("paper_id", "order", "self_ref", "parent_ref", "element_type")
    return cl.flag_inside_picture(src).select("paper_id", "order", "inside_picture")


@query("margin_line_number", """
    SELECT p_partkey, p_retailprice - 900 <= 40 OR p_retailprice - 900 + p_size >= 612 * 0.92
        OR (p_retailprice - 900 > 500 AND p_size < 30) AS is_margin
    FROM part
""")
def _(spark, d):
    boxed = table(spark, d, "part").selectExpr(
        "p_partkey", "CAST(p_size AS STRING) AS text",
        "named_struct('l', p_retailprice - 900, 'r', p_retailprice - 900 + p_size) AS bbox",
    )
    return boxed.selectExpr("p_partkey", f"{cl.is_margin_line_number('text', 'bbox', '612D')} AS is_margin")


@query("classify_keep", """
    SELECT paper_id, ord AS "order", exclusion_reason IS NULL AS keep_for_text, exclusion_reason FROM audit
""", uses="audit")
def _(spark, d):
    flagged = cl.flag_inside_picture(elements(spark, d))
    return cl.classify_keep(flagged).select("paper_id", "order", "keep_for_text", "exclusion_reason")


@query("duplicate_header", """
    SELECT paper_id, ord AS "order", label = 'page_header' AND text <> '' AND
      row_number() OVER (PARTITION BY paper_id, text, label ORDER BY ord) > 1 AS duplicate_header FROM el
""", uses="el")
def _(spark, d):
    src = elements(spark, d).select("paper_id", "order", "label", "text")
    return cl.duplicate_headers(src).select("paper_id", "order", "duplicate_header")


@query("section_path", """
    SELECT paper_id, ord AS "order", array_to_string(section_path, ' > ') AS section_path, header_order FROM audit
""", uses="audit")
def _(spark, d):
    src = elements(spark, d).select(
        "paper_id", "order", "page", "element_type", "label", "level", "tree_level", "text"
    )
    return cl.section_path(src).select("paper_id", "order", joined_path().alias("section_path"), "header_order")


@query("build_sections", "SELECT * FROM sections", uses="sections")
def _(spark, d):
    return cl.build_sections(elements(spark, d))


@query("section_elements", """
    SELECT a.paper_id, s.section_id, printf('el_%04d', a.ord) AS element_id, a.ord AS "order"
    FROM audit a JOIN sections s ON s.paper_id = a.paper_id AND s.header_order = a.header_order
""", uses="audit sections")
def _(spark, d):
    return cl.section_elements(audit(spark, d), cl.build_sections(elements(spark, d)))


@query("infer_title", "SELECT * FROM titles", uses="titles")
def _(spark, d):
    return cl.infer_title(elements(spark, d))


@query("extract_references", """
    SELECT paper_id, ord AS "order", text FROM kept WHERE starts_with(lower(section_path[-1]), 'reference')
    UNION ALL SELECT paper_id, ord, text FROM kept WHERE starts_with(lower(section_path[-1]), 'the')
""", uses="kept")
def _(spark, d):
    e = kept(spark, d)
    # No heading of the given texts starts with "reference"; a heading word that does occur is tried as well.
    return cl.extract_references(e).unionByName(cl.extract_references(e, heading="the"))


@query("cleaning_statistics", """
    SELECT paper_id, count(*) AS total_elements, count(*) FILTER (exclusion_reason IS NULL) AS kept_for_text,
      count(*) FILTER (exclusion_reason IS NOT NULL) AS excluded,
      count(*) FILTER (element_type IN ('SectionHeaderItem', 'TitleItem')) AS section_count,
      count(*) FILTER (exclusion_reason IS NULL) AS text_element_count
    FROM audit GROUP BY 1
""", uses="audit")
def _(spark, d):
    return cl.cleaning_statistics(audit(spark, d))


@query("exclusion_counts", """
    SELECT paper_id, exclusion_reason, count(*) AS n FROM audit WHERE exclusion_reason IS NOT NULL GROUP BY 1, 2
""", uses="audit")
def _(spark, d):
    return cl.exclusion_counts(audit(spark, d))


@query("element_counts", """
    SELECT paper_id, 'type' AS facet, element_type AS value, count(*) AS n FROM el GROUP BY 1, 2, 3
    UNION ALL SELECT paper_id, 'label', label, count(*) FROM el GROUP BY 1, 2, 3
    UNION ALL SELECT paper_id, 'page', CAST(page AS VARCHAR), count(*) FROM el GROUP BY 1, 2, 3
""", uses="el")
def _(spark, d):
    return cl.element_counts(elements(spark, d))


@query("render_markdown", """
    WITH pieces AS (
      SELECT k.paper_id, k.ord, CASE WHEN len(section_path) > 0 AND section_path IS DISTINCT FROM prev
          THEN repeat('#', least(len(section_path) + 1, 6)) || ' ' || section_path[-1] || chr(10) || chr(10)
          ELSE '' END || text || chr(10) || chr(10) AS piece
      FROM (SELECT *, last_value(CASE WHEN len(section_path) > 0 THEN section_path END IGNORE NULLS) OVER (
          PARTITION BY paper_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM kept) k
      UNION ALL SELECT paper_id, 0, CASE WHEN title <> '' THEN '# ' || title || chr(10) || chr(10) ELSE '' END FROM titles)
    SELECT paper_id, 0 AS part, trim(string_agg(piece, '' ORDER BY ord), ' ' || chr(10)) || chr(10) AS markdown
    FROM pieces GROUP BY 1
""", uses="kept titles")
def _(spark, d):
    return cl.render_markdown(kept(spark, d), cl.infer_title(elements(spark, d)))


@query("filter_elements", """
    SELECT paper_id, ord AS "order", text FROM audit WHERE exclusion_reason IS NULL
      AND lower(element_type) = 'textitem' AND page = 2
      AND contains(lower(array_to_string(section_path, ' > ')), 'th')
""", uses="audit")
def _(spark, d):
    found = cl.filter_elements(audit(spark, d), type="textitem", page=2, section="TH", kept_only=True)
    return found.select("paper_id", "order", "text")


@query("audit_elements", """
    SELECT paper_id, printf('el_%04d', ord) AS element_id, ord AS "order", self_ref, parent_ref, page, 1 AS tree_level,
      element_type, label, 'body' AS content_layer, array_to_string(section_path, ' > ') AS section_path, text,
      n AS text_length, CAST(n AS DOUBLE) AS box_left, 'BOTTOMLEFT' AS coordinate_origin, inside_picture,
      exclusion_reason IS NULL AS keep_for_text, exclusion_reason
    FROM audit
""", uses="audit")
def _(spark, d):
    a = cl.audit_elements(elements(spark, d))
    cols = [joined_path().alias(c) if c == "section_path" else F.col("bounding_box.l").alias("box_left")
            if c == "bounding_box" else F.col(c) for c in cl.AUDIT_COLUMNS]
    return a.select("paper_id", *cols)


@query("validate_parse", """
    WITH r AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'FAILURE' WHEN 'P' THEN 'SUCCESS' ELSE 'SUCCESS' END AS status,
        CASE WHEN o_orderpriority = '1-URGENT' THEN ['std::BAD_ALLOC ' || o_orderkey]
             WHEN o_orderpriority = '2-HIGH' THEN ['slow page', 'slow page'] ELSE [] END AS errors,
        month(o_orderdate) AS expected, day(o_orderdate) % 16 AS processed, year(o_orderdate) % 10 AS doc_pages
      FROM orders),
    v AS (SELECT *, CASE WHEN contains(lower(array_to_string(errors, ' ')), 'bad_alloc')
            THEN 'Native allocation failure: ' || errors[1]
          WHEN status = 'FAILURE' THEN coalesce(nullif(array_to_string(errors, '; '), ''), 'Conversion FAILURE')
          WHEN processed = 0 AND doc_pages = 0 THEN 'Empty conversion output'
          WHEN processed <> 0 AND processed < expected
            THEN printf('Processed pages %d < expected PDF pages %d', processed, expected) END AS reason FROM r)
    SELECT o_orderkey, reason, reason IS NULL AS accepted,
      CASE WHEN reason IS NOT NULL THEN '' ELSE array_to_string(list_filter([
        CASE WHEN doc_pages <> 0 AND doc_pages < expected THEN
          printf('Document page count %d differs from PDF page count %d', doc_pages, expected) END,
        errors[1]], lambda x: x IS NOT NULL), '; ') END AS warnings
    FROM v
""")
def _(spark, d):
    reports = table(spark, d, "orders").selectExpr(
        "o_orderkey",
        "IF(o_orderstatus = 'F', 'FAILURE', 'SUCCESS') AS status",
        "CASE o_orderpriority WHEN '1-URGENT' THEN array(concat('std::BAD_ALLOC ', o_orderkey)) "
        "WHEN '2-HIGH' THEN array('slow page', 'slow page') ELSE CAST(array() AS array<string>) END AS errors",
        "day(o_orderdate) % 16 AS processed_pages",
        "year(o_orderdate) % 10 AS document_pages",
        "true AS has_document",
        "month(o_orderdate) AS expected_pages",
    )
    return cl.validate_parse(reports).selectExpr(
        "o_orderkey", "reason", "accepted", "array_join(warnings, '; ') AS warnings"
    )


@query("needs_ocr", """
    SELECT paper_id, coalesce(sum(n) FILTER (page <= 3), 0) AS chars, coalesce(sum(n) FILTER (page <= 3), 0) < 200 AS needs_ocr
    FROM el GROUP BY 1
""", uses="el")
def _(spark, d):
    return cl.needs_ocr(elements(spark, d).select("paper_id", "page", "text"))
