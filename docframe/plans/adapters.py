"""The given tables in the shapes the operators take; nothing is invented."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docframe.session import scratch_path

# Stage tables written in this session: (application, folder, name) -> path.
_STAGES: dict[tuple[str, str, str], str] = {}


def stage(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A stored table of the library, built on first use and read by every later query,
    as an ingest job would leave it in the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STAGES:
        path = scratch_path(spark, name)
        build().write.option("compression", "zstd").parquet(path)
        _STAGES[key] = path
    return spark.read.parquet(_STAGES[key])


def stage_folder(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], None]) -> str:
    """Folder of a stored structure of several tables, written on first use."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STAGES:
        path = scratch_path(spark, name)
        write(path)
        _STAGES[key] = path
    return _STAGES[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_KIND = """CASE WHEN t RLIKE '[0-9]{3,}' THEN 'PictureItem' WHEN contains(t, ' | ') THEN 'TableItem'
  WHEN t RLIKE '[%#*&$]{3}' THEN 'FormulaItem' WHEN i = 0 AND length(t) < 40 THEN 'TitleItem'
  WHEN length(t) >= 12 AND length(t) < 40 THEN 'SectionHeaderItem' ELSE 'TextItem' END"""


def elements_of(documents: DataFrame) -> DataFrame:
    """Parsed elements from document lines; works on batch and streaming input.

    Ten lines make a page. Lines with a run of three digits stand for pictures, with
    a spaced bar for tables, with three junk signs for formulas; a short first line is
    the title, short lines are section headers (level by length), the shortest are
    page headers. The line after a picture belongs to it.
    """
    return (
        documents.selectExpr(
            "CAST(doc_id AS STRING) AS paper_id",
            f"transform(split(text, '\\n'), (t, i) -> named_struct('text', t, 'kind', {_KIND})) AS lines",
        )
        .selectExpr(
            "paper_id",
            "posexplode(arrays_zip(lines, slice(concat(array(CAST(NULL AS STRING)), lines.kind), 1, size(lines))))",
        )
        .selectExpr(
            "paper_id", "CAST(pos + 1 AS BIGINT) AS order", "col.lines.text AS text",
            "col.lines.kind AS element_type", "col.`1` AS prev",
        )
        .selectExpr(
            "paper_id",
            "order",
            "concat('#/items/', order) AS self_ref",
            "IF(prev = 'PictureItem' AND element_type NOT IN ('PictureItem', 'TableItem', 'FormulaItem'), "
            "concat('#/items/', order - 1), '#/body') AS parent_ref",
            "CAST((order - 1) DIV 10 + 1 AS INT) AS page",
            "1 AS tree_level",
            "element_type",
            "CASE element_type WHEN 'PictureItem' THEN 'picture' WHEN 'TableItem' THEN 'table' "
            "WHEN 'FormulaItem' THEN 'formula' WHEN 'TitleItem' THEN 'title' "
            "WHEN 'SectionHeaderItem' THEN 'section_header' "
            "ELSE IF(length(text) < 12, 'page_header', 'text') END AS label",
            "IF(element_type = 'SectionHeaderItem', CAST(1 + (length(text) - 12) DIV 10 AS INT), NULL) AS level",
            "'body' AS content_layer",
            "text",
            "named_struct('l', CAST(length(text) AS DOUBLE), 't', CAST(order AS DOUBLE), "
            "'r', CAST(length(text) + 20 AS DOUBLE), 'b', CAST(order + 10 AS DOUBLE), "
            "'coord_origin', 'BOTTOMLEFT') AS bbox",
            "612D AS page_width",
            "substring_index(text, ' ', 3) AS caption_text",
            "slice(split(text, ' '), 4, 2) AS captions",
        )
    )


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(
        spark, sf_dir, "elements",
        lambda: elements_of(table(spark, sf_dir, "documents").select("doc_id", "text")),
    )
