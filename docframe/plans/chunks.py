"""Queries over visual elements and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from docframe.operators import chunking as ck
from docframe.operators import cleaning as cl
from docframe.operators import visuals as vs
from docframe.plans.adapters import elements, stage, table
from docframe.plans.reference_sql import cte
from docframe.plans.registry import query
from docframe.plans.structure import audit, joined_path, kept

# Window sizes of the fixed-window chunks that the SQL side repeats.
FIXED = ck.ChunkingConfig(parent_max_tokens=200, child_max_tokens=60, overlap_tokens=10, splitter="fixed")

cte("vis", "el", """
    SELECT *, CASE WHEN kind = 'formula' THEN NULL ELSE
        nullif(array_to_string(list_filter(list_concat([cap1], caps), lambda x: x <> ''), ' '), '') END AS caption
    FROM (SELECT *, CASE element_type WHEN 'TableItem' THEN 'table' WHEN 'PictureItem' THEN 'figure' ELSE 'formula' END AS kind,
        printf(CASE element_type WHEN 'TableItem' THEN 'table_%03d' WHEN 'PictureItem' THEN 'figure_%03d' ELSE 'formula_%03d' END,
          row_number() OVER (PARTITION BY paper_id, element_type ORDER BY ord)) AS visual_id,
        array_to_string(list_slice(string_split(text, ' '), 1, 3), ' ') AS cap1,
        list_slice(string_split(text, ' '), 4, 5) AS caps
      FROM el WHERE element_type IN ('TableItem', 'PictureItem', 'FormulaItem'))
""")
cte("around", "el", """
    SELECT paper_id, vord, list(text ORDER BY ord)[1:4] AS near FROM (
      SELECT v.paper_id, v.ord AS vord, t.ord, t.text FROM el v JOIN el t ON v.paper_id = t.paper_id
        AND t.ord BETWEEN v.ord - 6 AND v.ord + 6 AND t.page = v.page AND t.text <> ''
        AND t.element_type NOT IN ('TableItem', 'PictureItem', 'FormulaItem')
      WHERE v.element_type IN ('TableItem', 'PictureItem', 'FormulaItem')) GROUP BY 1, 2
""")
cte("vchunks", "vis around", """
    SELECT v.paper_id, CASE WHEN kind = 'formula' THEN 'equation' ELSE kind END AS chunk_type, v.page,
      v.visual_id, k.ord IS NOT NULL AS has_internal,
      array_to_string(list_filter([v.caption, CASE WHEN kind = 'formula' THEN text END, array_to_string(a.near, ' ')],
        lambda x: x IS NOT NULL AND x <> ''), chr(10)) AS content
    FROM vis v LEFT JOIN around a ON a.paper_id = v.paper_id AND a.vord = v.ord
    LEFT JOIN (SELECT paper_id, ord, parent_ref FROM el WHERE parent_ref <> '#/body') k
      ON k.paper_id = v.paper_id AND k.parent_ref = v.self_ref
""")
cte("chunks", "parents children vchunks", r"""
    SELECT *, sha256(paper_id || '|' || chunk_type || '|' || ordinal) AS chunk_id,
      CASE WHEN content = '' THEN 0 ELSE greatest(1, len(regexp_extract_all(content, '\S+'))) END AS token_count
    FROM (
      SELECT paper_id, 'parent_passage' AS chunk_type, section_path, page_start, page_end, content, group_no, parent_no,
        CAST(NULL AS BIGINT) AS child_no, CAST(parent_no AS VARCHAR) AS ordinal, first_order, last_order FROM parents
      UNION ALL SELECT paper_id, 'text', section_path, page_start, page_end, content, NULL, parent_no, child_no,
        parent_no || '.' || child_no, NULL, NULL FROM children
      UNION ALL SELECT paper_id, chunk_type, [], page, page, content, NULL, NULL, NULL, visual_id, NULL, NULL FROM vchunks)
""")


def visuals(spark, d):
    return stage(spark, d, "visuals", lambda: vs.describe_visuals(elements(spark, d)))


def sections(spark, d):
    return stage(spark, d, "sections", lambda: cl.build_sections(elements(spark, d)))


def build_chunks(spark, d, config=FIXED):
    return ck.chunk(kept(spark, d), visuals(spark, d), config)


def chunks(spark, d):
    return stage(spark, d, "chunks", lambda: build_chunks(spark, d))


def parents(spark, d):
    return stage(spark, d, "parents", lambda: ck.split_parents(kept(spark, d), 200, 0, "fixed"))


@query("extract_visuals", """
    SELECT paper_id, visual_id AS element_id, kind AS type, page, caption, ord AS "order",
      CASE WHEN kind = 'formula' THEN text END AS docling_text, self_ref AS source_ref FROM vis
""", uses="vis")
def _(spark, d):
    return vs.extract_visuals(elements(spark, d)).select(
        "paper_id", "element_id", "type", "page", "caption", "order", "docling_text", "source_ref"
    )


@query("surrounding_text", """
    SELECT paper_id, vord AS "order", array_to_string(near, ' | ') AS near FROM around
""", uses="around")
def _(spark, d):
    return vs.surrounding_text(elements(spark, d)).selectExpr(
        "paper_id", "order", "array_join(surrounding_text, ' | ') AS near"
    )


@query("picture_internal_text", """
    SELECT paper_id, parent_ref AS source_ref, ord AS "order", text FROM el WHERE parent_ref <> '#/body' AND text <> ''
""", uses="el")
def _(spark, d):
    return vs.picture_internal_text(elements(spark, d))


@query("merge_captions", """
    SELECT l_orderkey, l_linenumber, nullif(trim(trim(l_returnflag) || ' ' || l_linestatus), '') AS caption FROM lineitem
""")
def _(spark, d):
    merged = vs.merge_captions("concat(' ', l_returnflag)", "array(concat(l_linestatus, '\\n'), '')")
    return table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{merged} AS caption")


@query("formula_needs_enrichment", """
    SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN true WHEN '2-HIGH' THEN true
      WHEN '3-MEDIUM' THEN true ELSE false END AS needs FROM orders
""")
def _(spark, d):
    text = "CASE o_orderpriority WHEN '1-URGENT' THEN NULL WHEN '2-HIGH' THEN ' Formula ' WHEN '3-MEDIUM' THEN ' ' ELSE 'a = b' END"
    return table(spark, d, "orders").selectExpr("o_orderkey", f"{text} AS t").selectExpr(
        "o_orderkey", f"{vs.formula_needs_enrichment('t')} AS needs"
    )


@query("enrichment_status", """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'enriched'
      WHEN o_orderpriority = '1-URGENT' THEN 'pending' ELSE 'not_required' END AS status FROM orders
""")
def _(spark, d):
    status = vs.enrichment_status("IF(o_orderstatus = 'F', 'enriched', NULL)", "o_orderpriority = '1-URGENT'")
    return table(spark, d, "orders").selectExpr("o_orderkey", f"{status} AS status")


@query("asset_manifest", """
    SELECT paper_id, 0 AS part, coalesce(string_agg(visual_id, ' ' ORDER BY ord) FILTER (kind = 'table'), '') AS tables,
      coalesce(string_agg(visual_id, ' ' ORDER BY ord) FILTER (kind = 'figure'), '') AS figures,
      coalesce(string_agg(visual_id, ' ' ORDER BY ord) FILTER (kind = 'formula'), '') AS formulas
    FROM vis GROUP BY 1
""", uses="vis")
def _(spark, d):
    return vs.asset_manifest(vs.extract_visuals(elements(spark, d))).selectExpr(
        "paper_id", "part", *[f"array_join({c}, ' ') AS {c}" for c in ("tables", "figures", "formulas")]
    )


@query("enrichment_candidates", """
    SELECT paper_id, visual_id AS element_id, kind AS type FROM vis WHERE kind = 'figure'
    UNION ALL SELECT paper_id, visual_id, kind FROM vis WHERE visual_id IN ('table_001', 'formula_001')
""", uses="vis")
def _(spark, d):
    v = vs.extract_visuals(elements(spark, d))
    plain = vs.enrichment_candidates(v, ["figure", "formula"])
    named = vs.enrichment_candidates(v, ["table", "formula"], ["table_001", "formula_001"], force=True)
    return plain.unionByName(named).select("paper_id", "element_id", "type")


@query("apply_enrichment", """
    SELECT paper_id, kind AS type, visual_id AS element_id, page,
      CASE WHEN kind = 'formula' THEN 'new: ' || text END AS docling_text FROM vis
""", uses="vis")
def _(spark, d):
    v = vs.extract_visuals(elements(spark, d)).select("paper_id", "type", "element_id", "page", "docling_text")
    updates = v.filter("type = 'formula'").withColumn("docling_text", F.concat(F.lit("new: "), "docling_text"))
    return vs.apply_enrichment(v, updates)


@query("coerce_enrichment", """
    SELECT p_partkey, CASE WHEN p_size > 25 THEN p_name WHEN p_size > 5 THEN p_type || ';' || p_brand
        ELSE 'brand: ' || p_brand || '; size: ' || p_size END AS columns,
      CASE WHEN p_size > 40 THEN '' ELSE CAST(p_size AS VARCHAR) END AS limitations, '' AS comparisons
    FROM part
""")
def _(spark, d):
    payload = table(spark, d, "part").selectExpr(
        "p_partkey",
        """concat('{"columns":', CASE WHEN p_size > 25 THEN to_json(array(p_name))
            WHEN p_size > 5 THEN to_json(array(p_type, p_brand))
            ELSE to_json(named_struct('brand', p_brand, 'size', p_size)) END,
          IF(p_size > 40, ',"limitations":null', concat(',"limitations":', p_size)), '}') AS payload""",
    )
    got = vs.coerce_enrichment("table", F.col("payload"))
    return payload.select(
        "p_partkey", *[F.array_join(got[c], ";").alias(c) for c in ("columns", "limitations", "comparisons")]
    )


@query("enrichment_budget", """
    WITH named AS (SELECT *, coalesce(nullif(array_to_string(section_path, ' › '), ''), 'Document') AS section FROM kept),
    secs AS (SELECT paper_id, section, min(ord) AS lo, string_agg(text, chr(10) || chr(10) ORDER BY ord)[1:6000] AS source
      FROM named GROUP BY 1, 2),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY lo) - 1 AS section_index FROM secs),
    used AS (SELECT *, coalesce(sum(length(source)) OVER (PARTITION BY paper_id ORDER BY section_index
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM ranked WHERE section_index < 8)
    SELECT paper_id, section, section_index, source[1:CAST(30000 - used AS BIGINT)] AS source FROM used WHERE used < 30000
""", uses="kept")
def _(spark, d):
    return vs.enrichment_budget(kept(spark, d))


@query("cache_split", """
    WITH keyed AS (SELECT doc_id, sha256('model|v1|' || source || '|' || text)[1:20] AS cache_key, source FROM documents),
    cache AS (SELECT DISTINCT cache_key FROM keyed JOIN labels USING (doc_id) WHERE quality = 1)
    SELECT doc_id, cache_key, cache_key IN (SELECT cache_key FROM cache) AS cached FROM keyed
""")
def _(spark, d):
    key = vs.text_cache_key("'model'", "'v1'", "source", "text")
    requests = table(spark, d, "documents").selectExpr("doc_id", f"{key} AS cache_key")
    good = table(spark, d, "labels").filter("quality = 1").select("doc_id")
    cache = requests.join(good, "doc_id").select("cache_key").distinct()
    hits, todo = vs.cache_split(requests, cache, "cache_key")
    return hits.unionByName(todo.withColumn("cached", F.lit(False)))


@query("group_by_section", """
    SELECT paper_id, group_no, 0 AS part, array_to_string(section_path, ' > ') AS section_path, text, page_start, page_end,
      first_order, last_order, n_elements FROM groups
""", uses="groups")
def _(spark, d):
    g = ck.group_by_section(kept(spark, d))
    return g.select(
        "paper_id", "group_no", "part", joined_path().alias("section_path"), "text", "page_start", "page_end",
        "first_order", "last_order", "n_elements",
    )


@query("split_parents", """
    SELECT paper_id, printf('parent_%04d', parent_no) AS parent_key, group_no, page_start, page_end, content FROM parents
""", uses="parents")
def _(spark, d):
    p = ck.split_parents(kept(spark, d), 200, 0, "fixed")
    return p.select("paper_id", "parent_key", "group_no", "page_start", "page_end", "content")


@query("split_children", """
    SELECT paper_id, printf('parent_%04d', parent_no) AS parent_key, child_no, page_start, page_end, content FROM children
""", uses="children")
def _(spark, d):
    return ck.split_children(parents(spark, d), 60, 10, "fixed").select(
        "paper_id", "parent_key", "child_no", "page_start", "page_end", "content"
    )


@query("split_recursive")
def _(spark, d):
    p = ck.split_parents(kept(spark, d))
    return ck.split_children(p).select("paper_id", "parent_key", "child_no", "content")


@query("visual_chunks", """
    SELECT paper_id, chunk_type, visual_id AS element_id, page AS page_start, content, has_internal AS has_internal_text
    FROM vchunks
""", uses="vchunks")
def _(spark, d):
    return ck.visual_chunks(visuals(spark, d)).select(
        "paper_id", "chunk_type", "element_id", "page_start", "content", "has_internal_text"
    )


@query("chunk", """
    SELECT paper_id, chunk_id, chunk_type, array_to_string(section_path, ' > ') AS section_path, page_start, page_end,
      content, token_count FROM chunks
""", uses="chunks")
def _(spark, d):
    return build_chunks(spark, d).select(
        "paper_id", "chunk_id", "chunk_type", joined_path().alias("section_path"), "page_start", "page_end",
        "content", "token_count",
    )


@query("chunk_metrics", """
    SELECT paper_id, count(*) FILTER (chunk_type = 'parent_passage') AS parent_count,
      count(*) FILTER (chunk_type <> 'parent_passage') AS child_count, count(*) AS total_chunks,
      round(avg(token_count), 2) AS avg_tokens, min(token_count) AS min_tokens, max(token_count) AS max_tokens,
      count(*) FILTER (chunk_type IN ('table', 'figure', 'equation')) AS visual_chunks,
      coalesce(max(group_no), 0) AS section_groups
    FROM chunks GROUP BY 1
""", uses="chunks")
def _(spark, d):
    return ck.chunk_metrics(chunks(spark, d))


@query("orphaned_elements", """
    SELECT k.paper_id, printf('el_%04d', k.ord) AS element_id, k.ord AS "order" FROM audit k
    WHERE NOT EXISTS (SELECT 1 FROM kept p WHERE p.paper_id = k.paper_id AND p.ord = k.ord)
""", uses="audit kept")
def _(spark, d):
    # Against all elements, so that the excluded ones remain.
    return ck.orphaned_elements(audit(spark, d), parents(spark, d).withColumn("chunk_type", F.lit(ck.PARENT)))


@query("link_parents", """
    SELECT c.paper_id, c.chunk_id, p.chunk_id AS parent_chunk_id FROM chunks c
    LEFT JOIN chunks p ON p.paper_id = c.paper_id AND p.chunk_type = 'parent_passage' AND c.chunk_type = 'text'
      AND p.parent_no = c.parent_no
""", uses="chunks")
def _(spark, d):
    return ck.link_parents(chunks(spark, d)).select("paper_id", "chunk_id", "parent_chunk_id")


@query("chunk_report", """
    SELECT paper_id, chunk_type AS item, count(*) AS n, 0 AS chars FROM chunks WHERE chunk_type <> 'parent_passage' GROUP BY 1, 2
    UNION ALL SELECT paper_id, printf('parent_%04d', parent_no), token_count, length(content) FROM chunks
    WHERE chunk_type = 'parent_passage' AND parent_no <= 20
""", uses="chunks")
def _(spark, d):
    parents, counts = ck.chunk_report(chunks(spark, d))
    return counts.selectExpr("paper_id", "chunk_type AS item", "n", "0 AS chars").union(
        parents.selectExpr("paper_id", "format_string('parent_%04d', parent_no)", "CAST(token_count AS BIGINT)", "chars")
    )


@query("list_chunks", """
    SELECT paper_id, chunk_id, chunk_type, page_start, page_end, token_count, false AS has_embedding,
      content[1:240] AS preview FROM chunks
""", uses="chunks")
def _(spark, d):
    return ck.list_chunks(chunks(spark, d)).drop("section_path")


@query("assign_section_ids", """
    SELECT k.paper_id, k.ord AS "order", (SELECT min_by(s.section_id, s.order_index) FROM sections s
      WHERE s.paper_id = k.paper_id AND s.heading = k.section_path[-1]) AS section_id FROM kept k
""", uses="kept sections")
def _(spark, d):
    return ck.assign_section_ids(kept(spark, d), sections(spark, d)).select("paper_id", "order", "section_id")
