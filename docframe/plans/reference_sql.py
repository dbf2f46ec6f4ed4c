"""Shared table expressions of the SQL counterparts, in DuckDB's dialect.

They restate in plain SQL what the adapters and the structural operators compute,
without the block-wise execution that the Spark side uses.
"""

from __future__ import annotations

_CTES: dict[str, tuple[str, str]] = {}


def cte(name: str, needs: str, body: str) -> None:
    if name in _CTES:
        raise ValueError(f"duplicate table expression {name}")
    _CTES[name] = (needs, body.strip())


def expand(names: list[str]) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in _CTES[n][0].split():
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return ""
    return "WITH " + ",\n".join(f"{n} AS ({_CTES[n][1]})" for n in order)


# Elements from document lines; see adapters.elements for the typing rules.
cte("lines", "", """
    SELECT paper_id, unnest(a) AS text, generate_subscripts(a, 1) AS ord
    FROM (SELECT CAST(doc_id AS VARCHAR) AS paper_id, string_split(text, chr(10)) AS a FROM documents)
""")
cte("typed", "lines", """
    SELECT paper_id, ord, text, (ord - 1) // 10 + 1 AS page, length(text) AS n,
      CASE WHEN regexp_matches(text, '[0-9]{3,}') THEN 'PictureItem'
           WHEN contains(text, ' | ') THEN 'TableItem'
           WHEN regexp_matches(text, '[%#*&$]{3}') THEN 'FormulaItem'
           WHEN ord = 1 AND length(text) < 40 THEN 'TitleItem'
           WHEN length(text) >= 12 AND length(text) < 40 THEN 'SectionHeaderItem'
           ELSE 'TextItem' END AS element_type
    FROM lines
""")
cte("el", "typed", """
    SELECT *, '#/items/' || ord AS self_ref,
      CASE WHEN lag(element_type) OVER w = 'PictureItem'
            AND element_type NOT IN ('PictureItem', 'TableItem', 'FormulaItem')
           THEN '#/items/' || (ord - 1) ELSE '#/body' END AS parent_ref,
      CASE element_type WHEN 'PictureItem' THEN 'picture' WHEN 'TableItem' THEN 'table'
           WHEN 'FormulaItem' THEN 'formula' WHEN 'TitleItem' THEN 'title'
           WHEN 'SectionHeaderItem' THEN 'section_header'
           ELSE CASE WHEN n < 12 THEN 'page_header' ELSE 'text' END END AS label,
      CASE WHEN element_type = 'SectionHeaderItem' THEN 1 + (n - 12) // 10 END AS level
    FROM typed WINDOW w AS (PARTITION BY paper_id ORDER BY ord)
""")
cte("hdr", "el", """
    SELECT paper_id, ord, page, text AS heading, element_type, coalesce(level, 1) AS level,
      row_number() OVER (PARTITION BY paper_id ORDER BY ord) AS section_no
    FROM el WHERE element_type IN ('SectionHeaderItem', 'TitleItem')
""")
cte("hpath", "hdr", """
    SELECT a.paper_id, a.ord, list(b.heading ORDER BY b.ord) AS section_path
    FROM hdr a JOIN hdr b ON a.paper_id = b.paper_id AND b.ord <= a.ord
    WHERE NOT EXISTS (SELECT 1 FROM hdr c WHERE c.paper_id = a.paper_id
      AND c.ord > b.ord AND c.ord <= a.ord AND c.level <= b.level)
    GROUP BY 1, 2
""")
cte("audit", "el hpath", """
    SELECT e.*, coalesce(p.section_path, []) AS section_path,
      e.parent_ref <> '#/body' AS inside_picture,
      CASE WHEN e.element_type IN ('TableItem', 'PictureItem', 'FormulaItem') THEN 'visual_element'
           WHEN e.label = 'page_header' THEN 'label:page_header'
           WHEN e.text = '' THEN 'empty_text'
           WHEN e.parent_ref <> '#/body' THEN 'inside_picture'
           WHEN regexp_matches(e.text, '^[0-9]{1,4}$') AND e.n <= 40 THEN 'margin_line_number'
      END AS exclusion_reason
    FROM (SELECT *, max(CASE WHEN element_type IN ('SectionHeaderItem', 'TitleItem') THEN ord END)
            OVER (PARTITION BY paper_id ORDER BY ord) AS header_order FROM el) e
    LEFT JOIN hpath p ON p.paper_id = e.paper_id AND p.ord = e.header_order
""")
cte("kept", "audit", "SELECT * FROM audit WHERE exclusion_reason IS NULL")
cte("sections", "audit hdr", """
    SELECT h.paper_id, printf('section_%03d', h.section_no) AS section_id, h.section_no - 1 AS order_index,
      h.heading, h.level, h.page AS page_start, s.page_end, h.ord AS header_order,
      s.first_order, s.last_order, s.n_elements
    FROM hdr h JOIN (SELECT paper_id, header_order, arg_max(page, ord) AS page_end, min(ord) AS first_order,
        max(ord) AS last_order, count(*) AS n_elements FROM audit GROUP BY 1, 2) s
      ON s.paper_id = h.paper_id AND s.header_order = h.ord
""")
cte("titles", "hdr el", """
    SELECT p.paper_id, t.heading AS title,
      CASE WHEN t.heading IS NULL THEN 'unknown' WHEN t.element_type = 'TitleItem' THEN 'medium' ELSE 'low' END
        AS title_confidence
    FROM (SELECT DISTINCT paper_id FROM el) p
    LEFT JOIN (SELECT * FROM hdr WHERE level = 1
      QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY ord) = 1) t USING (paper_id)
""")
# Consecutive runs of kept elements with one path.
cte("runs", "kept", """
    SELECT *, sum(fresh) OVER (PARTITION BY paper_id ORDER BY ord) AS group_no FROM (
      SELECT *, CASE WHEN lag(section_path) OVER w IS NOT DISTINCT FROM section_path
          AND lag(ord) OVER w IS NOT NULL THEN 0 ELSE 1 END AS fresh
      FROM kept WINDOW w AS (PARTITION BY paper_id ORDER BY ord))
""")
cte("groups", "runs", """
    SELECT paper_id, group_no, any_value(section_path) AS section_path,
      string_agg(text, chr(10) || chr(10) ORDER BY ord) AS text,
      min(page) AS page_start, max(page) AS page_end, min(ord) AS first_order, max(ord) AS last_order,
      count(*) AS n_elements
    FROM runs GROUP BY 1, 2
""")
# Fixed-window chunks: 200-token parents without overlap, 60-token children sharing 10.
cte("parents", "groups", """
    SELECT paper_id, section_path, page_start, page_end, group_no, piece, first_order, last_order,
      array_to_string(list_slice(toks, (piece - 1) * 200 + 1, piece * 200), ' ') AS content,
      row_number() OVER (PARTITION BY paper_id ORDER BY group_no, piece) AS parent_no
    FROM (SELECT *, unnest(generate_series(1, greatest(1, CAST(ceil(len(toks) / 200.0) AS BIGINT)))) AS piece
      FROM (SELECT *, regexp_extract_all(text, '\\S+') AS toks FROM groups))
""")
cte("children", "parents", """
    SELECT paper_id, section_path, page_start, page_end, parent_no, piece AS child_no,
      array_to_string(list_slice(toks, (piece - 1) * 50 + 1, (piece - 1) * 50 + 60), ' ') AS content
    FROM (SELECT *, unnest(generate_series(1, 1 + greatest(0, CAST(ceil((len(toks) - 60) / 50.0) AS BIGINT)))) AS piece
      FROM (SELECT * EXCLUDE (piece), regexp_extract_all(content, '\\S+') AS toks FROM parents))
""")
