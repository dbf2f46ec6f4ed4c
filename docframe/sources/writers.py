"""Writing artifacts and tables. Long papers are spread over many files; nothing is
gathered per paper beyond a part of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.functions.text import lit
from docframe.operators.cleaning import AUDIT_COLUMNS, PART_ROWS
from docframe.operators.ordered import in_order, sql
from docframe.sources.listing import write_folders


def write_cleaned_jsonl(elements: DataFrame, path: str) -> None:
    """Kept elements as JSON lines, a folder per paper (S3)."""
    rows = elements.selectExpr(
        "paper_id", "element_id", "order", "page", "section_path AS section", "type AS element_type", "label",
        "bounding_box", "coordinate_origin", "source_ref", "text",
    )
    placed = rows.repartitionByRange("paper_id", "order").sortWithinPartitions("paper_id", "order")
    write_folders(placed.select("paper_id", F.to_json(F.struct(*rows.columns[1:]))), path, ".json")


def audit_csv_rows(audit: DataFrame) -> DataFrame:
    """The 17 audit columns as CSV can hold them."""
    flat = {"section_path": "array_join(section_path, ' > ')", "bounding_box": "coalesce(to_json(bounding_box), '')"}
    return audit.selectExpr("paper_id", *[f"{flat.get(c, c)} AS `{c}`" for c in AUDIT_COLUMNS])


def write_audit_csv(audit: DataFrame, path: str) -> None:
    """Audit rows as CSV with a header."""
    rows = audit_csv_rows(audit)
    options = {"quote": '"', "escape": '"'}
    placed = rows.repartitionByRange("paper_id", "order").sortWithinPartitions("paper_id", "order")
    write_folders(placed.select("paper_id", F.to_csv(F.struct(*AUDIT_COLUMNS), options)), path, ".csv", ",".join(AUDIT_COLUMNS) + "\n")


def nest_documents(
    titles: DataFrame, sections: DataFrame, elements: DataFrame, visuals: DataFrame, part_rows: int = PART_ROWS
) -> DataFrame:
    """Nested documents (S5), one row per ``part_rows`` element orders: below that size a
    paper is one row. Arrays of the parts concatenate in order. Every paper of ``titles`` has
    a document, if only an empty one."""
    last = "startswith(lower(try_element_at(section_path, -1)), 'reference')"
    rows = [
        elements.selectExpr(
            "paper_id", "order", "'text' AS kind",
            "named_struct('element_id', element_id, 'order', order, 'page', page, 'section_path', section_path, 'text', text) AS t",
            "CAST(NULL AS struct<section_id:string,heading:string,level:int,page_start:int,page_end:int>) AS s",
            "CAST(NULL AS struct<element_id:string,page:int,caption:string,docling_text:string>) AS v",
            f"IF({last}, text, NULL) AS r",
        ),
        sections.selectExpr(
            "paper_id", "header_order AS order", "'section' AS kind",
            "named_struct('section_id', section_id, 'heading', heading, 'level', level, 'page_start', page_start, 'page_end', page_end) AS s",
        ),
        visuals.selectExpr(
            "paper_id", "order", "type AS kind",
            "named_struct('element_id', element_id, 'page', page, 'caption', caption, 'docling_text', docling_text) AS v",
        ),
    ]
    rows.append(titles.selectExpr("paper_id", "0L AS order", "'paper' AS kind"))
    every = rows[0]
    for more in rows[1:]:
        every = every.unionByName(more, allowMissingColumns=True)
    pick = lambda kind, col: f"filter({in_order('order', f'IF(kind = {lit(kind)}, {col}, NULL)')}, x -> x IS NOT NULL)"
    return sql(
        f"""
        SELECT d.paper_id, d.part, t.title, d.sections, d.text_elements, d.tables, d.figures, d.formulas, d.references
        FROM (SELECT paper_id, order DIV {part_rows} AS part, {pick('section', 's')} AS sections, {pick('text', 't')} AS text_elements,
            {pick('table', 'v')} AS tables, {pick('figure', 'v')} AS figures, {pick('formula', 'v')} AS formulas, {pick('text', 'r')} AS references
          FROM {{e}} GROUP BY paper_id, order DIV {part_rows}) d
        LEFT JOIN {{t}} t ON d.paper_id = t.paper_id
        """,
        e=every,
        t=titles,
    )


def write_documents_json(documents: DataFrame, path: str) -> None:
    """Nested documents as JSON lines."""
    documents.write.json(path)


def write_markdown(markdown: DataFrame, path: str) -> None:
    """Markdown parts as text, a folder per paper."""
    rows = markdown.repartitionByRange("paper_id", "part").sortWithinPartitions("paper_id", "part")
    write_folders(rows.selectExpr("paper_id", "coalesce(rtrim('\\n', markdown), '') AS value"), path, ".txt")


def write_embeddings(index_rows: DataFrame, path: str, mode: str = "error") -> None:
    """Vector rows with their metadata."""
    index_rows.write.mode(mode).parquet(path)


def _drop_buckets(spark: SparkSession, path: str, buckets: list[int]) -> None:
    """Remove the folders of buckets."""
    jvm = spark.sparkContext._jvm
    for bucket in buckets:
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={bucket}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def overwrite_documents(batch: DataFrame, path: str, buckets: int = 256, renewed: DataFrame | None = None) -> None:
    """Replace the documents of a batch in a bucketed table.

    ``renewed`` names the documents to replace (paper_id) where some have no row left.

    Only the buckets that the batch touches are rewritten. The new content of those
    buckets is staged before they are replaced, since they are also read.
    """
    from docframe.operators.library import replace_documents
    from docframe.session import materialize

    spark = batch.sparkSession
    bucket = f"CAST(pmod(xxhash64(paper_id), {buckets}) AS INT) AS bucket"
    marked = batch.selectExpr("*", bucket)
    renewed = (batch if renewed is None else renewed).select("paper_id").distinct()
    empty: list[int] = []
    try:
        stored = spark.read.parquet(path)
        touched = materialize(renewed.selectExpr(bucket).distinct())
        marked = materialize(replace_documents(stored.join(touched, "bucket", "left_semi").select(*marked.columns), marked, renewed=renewed))
        # An overwrite by partition leaves buckets alone that have no row any more.
        empty = [r.bucket for r in touched.join(marked, "bucket", "left_anti").collect()]
    except Exception as exc:  # a first write finds nothing to merge with
        if "PATH_NOT_FOUND" not in str(exc) and "UNABLE_TO_INFER_SCHEMA" not in str(exc):
            raise
    marked.repartition("bucket", "paper_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    _drop_buckets(spark, path, empty)
