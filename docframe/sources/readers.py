"""Reading stored tables and incoming files."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docframe.functions.text import clean_filename
from docframe.schemas import DOCUMENT, TABLES
from docframe.sources.listing import list_files, read_folders

# Upload limit and the file signature.
MAX_UPLOAD_BYTES = 50 * 1024 * 1024
SIGNATURE = "%PDF"
LISTING_TASKS = 64
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def many_folders(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark lists the folders of a path in a few tasks; of itself it takes a task per
    folder (10,000 at most), whose start costs more than the listing."""
    before = spark.conf.get(_LISTING, None)
    spark.conf.set(_LISTING, str(LISTING_TASKS))
    try:
        yield
    finally:
        spark.conf.unset(_LISTING) if before is None else spark.conf.set(_LISTING, before)


def load_library(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The stored tables under their fixed schemas (S1); added columns read as null."""
    return {name: spark.read.schema(ddl).parquet(f"{root}/{name}") for name, ddl in TABLES.items()}


def _filled(lines: DataFrame, column: str, parse: Callable[[str], Column]) -> DataFrame:
    """Rows of non-blank lines (key, line), the key as ``column`` behind the others, where Spark puts a folder's value."""
    rows = lines.where("btrim(line, ' \\t') <> ''").select(F.col("key").alias(column), parse("line").alias("r"))
    return rows.select("r.*", column)


def _without(schema: StructType, column: str) -> StructType:
    return StructType([f for f in schema if f.name != column])


def read_jsonl(spark: SparkSession, path: str, schema: str, folders: str | None = None) -> DataFrame:
    """Non-blank lines as rows; a missing file reads as no rows (S2). ``folders`` names the column of
    a tree of folders as ``write_folders`` leaves it; its files are then not listed."""
    if folders is not None:
        kinds = StructType.fromDDL(schema)
        return _filled(read_folders(spark, path), folders, lambda c: F.from_json(c, _without(kinds, folders)))
    try:
        with many_folders(spark):
            return spark.read.schema(schema).json(path)
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def read_audit_csv(spark: SparkSession, path: str, schema: str, folders: str = "paper_id") -> DataFrame:
    """Rows of CSV files with a header in a tree of folders as ``write_folders`` leaves it."""
    kinds = StructType.fromDDL(schema)
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in _without(kinds, folders))
    options = {"quote": '"', "escape": '"'}
    return _filled(read_folders(spark, path, skip=1), folders, lambda c: F.from_csv(c, F.lit(own), options))


def read_arxiv_xml(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Atom files below ``path``: their entries under ``schema``, and the text of entries that
    could not be read (S10). A file is read in splits and cut at the ends of its entries, so a
    malformed one costs no other."""
    cut = spark.read.option("lineSep", "</entry>").text(path).selectExpr("regexp_extract(value, '(?s)<entry[ >].*', 0) AS body").where("body <> ''")
    options = {"attributePrefix": "_", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malformed", "ignoreNamespace": "true"}
    rows = cut.select(F.from_xml(F.concat("body", F.lit("</entry>")), f"{schema}, _malformed string", options).alias("e")).select("e.*")
    return rows.where("_malformed IS NULL").drop("_malformed"), rows.where("_malformed IS NOT NULL").select("_malformed")


def read_documents_json(spark: SparkSession, path: str) -> DataFrame:
    """Nested documents back from their sink (S5); explode the arrays to get rows."""
    return spark.read.schema(DOCUMENT).json(path)


def intake_reason(filename: str, length: str, head: str, max_bytes: int = MAX_UPLOAD_BYTES) -> str:
    """First reason to reject an upload, else null (S7). The extension is the cleaned name's."""
    return f"""CASE WHEN coalesce({filename}, '') = '' THEN 'no_filename'
        WHEN NOT endswith(lower({clean_filename(filename)}), '.pdf') THEN 'not_pdf_extension'
        WHEN {length} = 0 THEN 'empty' WHEN {length} > {max_bytes} THEN 'too_large'
        WHEN NOT ({head} <=> '{SIGNATURE}') THEN 'not_pdf_content' END"""


def intake_files(spark: SparkSession, path: str, max_bytes: int = MAX_UPLOAD_BYTES) -> tuple[DataFrame, DataFrame]:
    """Accepted files with content, and rejected ones with their reason.

    All files are listed, empty ones too; only those of an acceptable length are opened. The
    extension is that of the cleaned name, under which a file is stored.
    """
    head = f"decode(substring(content, 1, {len(SIGNATURE)}), 'iso-8859-1')"
    listed = list_files(spark, path, max_bytes).selectExpr("path", "filename", "length", "content")
    judged = listed.selectExpr("*", f"{intake_reason('filename', 'length', head, max_bytes)} AS reason")
    accepted = judged.filter("reason IS NULL").selectExpr("path", f"{clean_filename('filename')} AS filename", "length", "content")
    return accepted, judged.filter("reason IS NOT NULL").select("path", "filename", "length", "reason")


def inventory(objects: DataFrame) -> DataFrame:
    """Objects (path, length) counted per paper and kind."""
    pattern = r"r'([^/]+)/papers/([^/]+)/'"
    return (
        objects.selectExpr("path", "length", f"regexp_extract(path, {pattern}, 1) AS kind", f"regexp_extract(path, {pattern}, 2) AS paper_id")
        .filter("paper_id <> ''").groupBy("paper_id", "kind").agg({"path": "count", "length": "sum"})
        .withColumnsRenamed({"count(path)": "objects", "sum(length)": "bytes"})
    )


def artifact_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Stored artifacts per paper and kind (S8); contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return inventory(files.select("path", "length"))
