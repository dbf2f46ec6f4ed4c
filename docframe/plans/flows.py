"""Queries over sinks, file intake and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from docframe.functions.text import clean_filename
from docframe.operators import cleaning as cl
from docframe.operators import index as ix
from docframe.operators import retrieval as rt
from docframe.plans.adapters import elements, elements_of, stage_folder, table
from docframe.plans.chunks import FIXED, chunks, sections, visuals
from docframe.plans.registry import query
from docframe.plans.search import embedded
from docframe.plans.structure import audit, kept
from docframe.plans.tables import HTML_SQL, request_columns
from docframe.schemas import CLEANED
from docframe.session import scratch_path
from docframe.sources import readers, writers
from docframe.sources.listing import read_folders, write_files
from docframe.sources.versioned import DocumentStore
from docframe.streaming import jobs as st
from docframe.streaming import quota_state


def source_stream(spark, d, name):
    """A given table, a file or a folder of files, as a file stream; all that is there makes one batch."""
    schema = table(spark, d, name).schema
    # A pattern finds files as well as folders; a plain path must be a folder.
    return spark.readStream.schema(schema).parquet(f"{d.rstrip('/')}/{name}[.]parquet")


@query("cleaned_jsonl", "SELECT paper_id, printf('el_%04d', ord) AS element_id, page, array_to_string(section_path, ' > ') AS section, text FROM kept", uses="kept")
def _(spark, d):
    path = scratch_path(spark, "jsonl")
    writers.write_cleaned_jsonl(kept(spark, d), path)
    return readers.read_jsonl(spark, path, CLEANED, folders="paper_id").selectExpr("paper_id", "element_id", "page", "array_join(section, ' > ') AS section", "text")


@query("audit_csv", """
    SELECT paper_id, printf('el_%04d', ord) AS element_id, ord AS "order", nullif(array_to_string(section_path, ' > '), '') AS section_path, text,
      exclusion_reason IS NULL AS keep_for_text, exclusion_reason FROM audit
""", uses="audit")
def _(spark, d):
    path = scratch_path(spark, "csv")
    writers.write_audit_csv(audit(spark, d), path)
    schema = ", ".join(f"`{c}` {'bigint' if c == 'order' else 'boolean' if c == 'keep_for_text' else 'string'}" for c in cl.AUDIT_COLUMNS)
    back = readers.read_audit_csv(spark, path, schema + ", paper_id string")
    return back.select("paper_id", "element_id", "order", "section_path", "text", "keep_for_text", "exclusion_reason")


@query("documents_json", """
    SELECT t.paper_id, t.title, (SELECT count(*) FROM sections s WHERE s.paper_id = t.paper_id) AS sections,
      coalesce((SELECT string_agg(text, '|' ORDER BY ord) FROM kept k WHERE k.paper_id = t.paper_id), '') AS texts,
      coalesce((SELECT string_agg(visual_id, '|' ORDER BY ord) FROM vis v WHERE v.paper_id = t.paper_id AND kind = 'table'), '') AS tables
    FROM titles t
""", uses="titles sections kept vis")
def _(spark, d):
    path = scratch_path(spark, "documents")
    docs = writers.nest_documents(cl.infer_title(elements(spark, d)), sections(spark, d), kept(spark, d), visuals(spark, d))
    writers.write_documents_json(docs, path)
    return readers.read_documents_json(spark, path).selectExpr(
        "paper_id", "title", "size(sections) AS sections", "array_join(text_elements.text, '|') AS texts", "array_join(tables.element_id, '|') AS tables")


@query("markdown_files", "SELECT CAST(count(*) AS BIGINT) AS lines FROM (SELECT unnest(string_split(text, chr(10))) FROM kept) x", uses="kept")
def _(spark, d):
    path = scratch_path(spark, "markdown")
    writers.write_markdown(cl.render_markdown(kept(spark, d), cl.infer_title(elements(spark, d))), path)
    # Body lines only: headings start with a hash, blank lines separate the pieces.
    written = read_folders(spark, path).withColumnRenamed("line", "value")
    return written.filter("value <> '' AND NOT value RLIKE '^#{1,6} '").agg(F.expr("count(*) AS lines"))


@query("vector_sink", "SELECT c.chunk_id, c.paper_id, c.citation, 64 AS dims FROM cited c", uses="cited")
def _(spark, d):
    path = scratch_path(spark, "vectors")
    writers.write_embeddings(ix.index_rows(embedded(spark, d), rt.citation_label()), path)
    return spark.read.parquet(path).selectExpr("chunk_id", "paper_id", "citation", "size(embedding) AS dims")


@query("intake_decisions", """
    SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'no_filename' WHEN 1 THEN 'not_pdf_extension' WHEN 2 THEN 'empty'
      ELSE CASE WHEN strlen(html) > 5000 THEN 'too_large' WHEN page_id % 7 = 3 THEN 'not_pdf_content' END END AS reason,
      CASE page_id % 7 WHEN 4 THEN 'a_b_1_.pdf' ELSE 'upload.pdf' END AS filename
    FROM pages
""")
def _(spark, d):
    p = table(spark, d, "pages").selectExpr(
        "page_id", "CASE page_id % 7 WHEN 0 THEN '' WHEN 1 THEN url WHEN 4 THEN '../x/.a b(1).PDF' ELSE 'upload.pdf' END AS name",
        "IF(page_id % 7 = 2, 0, octet_length(html)) AS length", "IF(page_id % 7 = 3, left(html, 4), '%PDF') AS head")
    return p.selectExpr("page_id", f"{readers.intake_reason('name', 'length', 'head', 5000)} AS reason",
                        f"IF(page_id % 7 = 4, lower({clean_filename('name')}), 'upload.pdf') AS filename")


@query("intake_listing", """
    SELECT page_id, reason, CASE WHEN reason IS NULL THEN 'Page_' || page_id || '.pdf' ELSE NULL END AS stored_as FROM (
      SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'not_pdf_extension' WHEN 2 THEN 'empty' WHEN 3 THEN 'not_pdf_content'
        ELSE CASE WHEN strlen(html) + 4 > 5000 THEN 'too_large' END END AS reason FROM pages)
""")
def _(spark, d):
    # Uploads written as real files: wrong extensions, empty ones, ones without the signature, large ones.
    path = scratch_path(spark, "uploads")
    uploads = table(spark, d, "pages").selectExpr(
        "concat('in', page_id % 5, '/Page ', page_id, IF(page_id % 7 = 0, '.html', ' .pdf')) AS name",
        "CASE page_id % 7 WHEN 2 THEN NULL WHEN 3 THEN CAST(left(html, 60) AS BINARY) WHEN 0 THEN CAST('x' AS BINARY) ELSE CAST(concat('%PDF', html) AS BINARY) END AS content")
    write_files(uploads, path)
    accepted, rejected = readers.intake_files(spark, path, 5000)
    number = "CAST(regexp_extract({c}, '(?i)page[ _]([0-9]+)', 1) AS BIGINT) AS page_id"
    return accepted.selectExpr(number.format(c="filename"), "CAST(NULL AS STRING) AS reason", "replace(filename, '_.pdf', '.pdf') AS stored_as").unionByName(
        rejected.selectExpr(number.format(c="filename"), "reason", "CAST(NULL AS STRING) AS stored_as"))


@query("inventory", """
    SELECT CAST(doc_id AS VARCHAR) AS paper_id, k AS kind, count(*) AS objects, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents, (VALUES ('raw'), ('normalized')) t(k) GROUP BY 1, 2
""")
def _(spark, d):
    objects = table(spark, d, "documents").selectExpr(
        "explode(array(concat('s3://b/raw/papers/', doc_id, '/a.pdf'), concat('s3://b/normalized/papers/', doc_id, '/d.json'))) AS path", "n_chars AS length")
    return readers.inventory(objects)


def ingested(spark, d):
    """Store that the stream over all documents fills."""
    def write(root):
        st.run_once(st.ingest_stream(elements_of(source_stream(spark, d, "documents").select("doc_id", "text")), root, scratch_path(spark, "checkpoint"), FIXED))

    return DocumentStore(stage_folder(spark, d, "ingested", write), spark)


@query("ingest_stream", "SELECT chunk_id, paper_id, chunk_type, content FROM chunks", uses="chunks")
def _(spark, d):
    return ingested(spark, d).read("chunks").select("chunk_id", "paper_id", "chunk_type", "content")


@query("ingest_outcome", """
    SELECT paper_id, CASE WHEN k = 0 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN k = 0 THEN 'no usable text' END AS error
    FROM (SELECT paper_id, count(*) FILTER (exclusion_reason IS NULL) AS k FROM audit GROUP BY 1)
""", uses="audit")
def _(spark, d):
    return ingested(spark, d).read("papers")


@query("document_store", """
    WITH marked AS (SELECT c.paper_id, c.content, coalesce(l.toxic, 0) AS toxic, l.quality FROM chunks c LEFT JOIN labels l ON CAST(l.doc_id AS VARCHAR) = c.paper_id)
    SELECT paper_id, count(*) AS n, max(CASE WHEN quality = 0 THEN 'renewed' ELSE 'first' END) AS origin FROM marked WHERE toxic = 0 GROUP BY 1
""", uses="chunks")
def _(spark, d):
    # Papers of poor quality come again, toxic ones are emptied; the last batch is repeated, then all is compacted.
    store = DocumentStore(scratch_path(spark, "store"), spark)
    rows = chunks(spark, d).select("paper_id", "content")
    labels = table(spark, d, "labels").selectExpr("CAST(doc_id AS STRING) AS paper_id", "quality", "toxic")
    first = lambda df, origin: {"chunks": df.withColumn("origin", F.lit(origin))}
    store.commit(0, rows, first(rows, "first"))
    poor, toxic = labels.where("quality = 0"), labels.where("toxic = 1")
    store.commit(1, poor, first(rows.join(poor, "paper_id", "left_semi"), "renewed"))
    for _ in range(2):
        store.commit(2, toxic, first(rows.where("false"), "none"))
    store.compact()
    return store.read("chunks").groupBy("paper_id").agg(F.count("*").alias("n"), F.max("origin").alias("origin"))


@query("job_progress_stream", """
    SELECT l_orderkey AS job_id, l_returnflag AS status, l_quantity AS progress FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_returnflag DESC, l_quantity DESC) = 1
""")
def _(spark, d):
    updates = source_stream(spark, d, "lineitem").selectExpr(
        "l_orderkey AS job_id", "l_shipdate AS updated_at", "l_linenumber AS update_id", "l_returnflag AS status", "l_quantity AS progress")
    path = scratch_path(spark, "progress")
    writer = st.job_progress_stream(updates).writeStream.outputMode("update").option("checkpointLocation", scratch_path(spark, "checkpoint"))
    st.run_once(writer.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{path}/v={i}")))
    # A job changed in several batches counts with its last.
    return spark.read.parquet(path).groupBy("job_id").agg(F.expr("max_by(struct(status, progress), v) AS s")).select("job_id", "s.*")


@query("guard_stream", f"SELECT page_id, {HTML_SQL.format('html')} AS html FROM pages")
def _(spark, d):
    path = scratch_path(spark, "guarded")
    safe = st.guard_stream(source_stream(spark, d, "pages").select("page_id", "html"), "html", ["sk-12345678"])
    st.run_once(safe.writeStream.format("parquet").option("checkpointLocation", scratch_path(spark, "checkpoint")).option("path", path))
    return spark.read.parquet(path)


DECIDED = "SELECT event_id AS request_id, admitted, CASE WHEN expired THEN 'expired' WHEN NOT admitted THEN kind END AS rejected_for FROM decided"


@query("admit_stream", DECIDED, uses="decided")
def _(spark, d):
    out = scratch_path(spark, "decisions")
    feed = source_stream(spark, d, "events").selectExpr(*request_columns())
    writer = quota_state.admit_stream(feed).writeStream.format("parquet").option("path", out)
    st.run_once(writer.option("checkpointLocation", scratch_path(spark, "checkpoint")))
    return spark.read.parquet(out).select("request_id", "admitted", "rejected_for")


@query("admit_batches", DECIDED, uses="decided")
def _(spark, d):
    state, out = scratch_path(spark, "sessions"), scratch_path(spark, "decisions")
    feed = source_stream(spark, d, "events").selectExpr(*request_columns())
    st.run_once(st.admit_batches(feed, state, out, scratch_path(spark, "checkpoint")))
    return spark.read.parquet(out).select("request_id", "admitted", "rejected_for")


@query("dedupe_stream", "SELECT DISTINCT trim(lower(text)) AS identity FROM documents")
def _(spark, d):
    feed = source_stream(spark, d, "documents").selectExpr("text AS title", "TIMESTAMP '2024-01-01 00:00:00' AS ts")
    path = scratch_path(spark, "unique")
    once = st.dedupe_stream(feed, "ts", "1 hour", "btrim(lower(title))")
    st.run_once(once.writeStream.format("parquet").option("checkpointLocation", scratch_path(spark, "checkpoint")).option("path", path))
    return spark.read.parquet(path).select("identity")
