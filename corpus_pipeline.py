"""Corpus pipeline: language ID, line dedup, near-dedup, decontamination, BPE.

Each stage takes (spark, docs, sf_dir), works on every row it is given and returns a
DataFrame; ``run`` writes each result to the shared folder and reads it again as the
next stage's input. Columns of the given documents are kept; texts and n_chars follow
the decisions. Defined results for nulls, empty and repeated texts are those of the
operators. Null ids are passed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.llm import bpe, decontaminate, language_id, line_dedup, near_dedup
from docframe.llm.queries import held_out, table, vocabulary
from docframe.session import materialize

# A document that would lose more of its characters is a copy of documents and is left to near-dedup.
MAX_LINE_SHARE = 0.5

ORACLE_SQL = None


ROW = "_pipeline_row"


def _held(docs: DataFrame, *columns: str) -> DataFrame:
    """The given rows in one column, beside the columns that an operator reads; what an
    operator adds cannot replace a given column of the same name."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW), *columns)


def _given(held: DataFrame, docs: DataFrame) -> DataFrame:
    return held.select(*[F.col(f"{ROW}.`{c}`") for c in docs.columns])


def _with_text(held: DataFrame, docs: DataFrame, text) -> DataFrame:
    """The given rows with another text; a changed text has its own n_chars."""
    own = F.col(f"{ROW}.text")
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(text.eqNullSafe(own), F.col(f"{ROW}.n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))
    return held.select(*[new[c].alias(c) if c in new else F.col(f"{ROW}.`{c}`") for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; texts without a letter and narrow margins go."""
    learned = language_id.learn(docs.where(~held_out()))
    return _given(language_id.classify(_held(docs, "text"), learned).where("NOT rejected"), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat an earlier line exactly or within one edit."""
    out = line_dedup.remove_lines(_held(docs, "doc_id", "text"), materialize, max_share=MAX_LINE_SHARE)
    return _with_text(out, docs, F.col("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: the one with the smallest id, once (of rows that repeat an id
    and a text, the first by their other columns). Null ids go where their class has another id;
    different texts that have only null ids all stay."""
    found = near_dedup.classes(docs, materialize).where("doc_id <=> class_id").select("doc_id", "text_hash").distinct()
    same = docs["doc_id"].eqNullSafe(found["doc_id"]) & (F.xxhash64(docs["text"]) == found["text_hash"])
    kept = docs.join(found, same, "left_semi")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    if not rest:
        return kept.distinct().select(*docs.columns)
    first = kept.groupBy("doc_id", "text").agg(F.min(F.struct(*[F.col(f"`{c}`") for c in rest])).alias(ROW))
    return first.select(*[F.col(f"{ROW}.`{c}`") if c in rest else F.col(c) for c in docs.columns])


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    found = decontaminate.decontaminate(_held(docs, "doc_id", "text"), items, materialize)
    return _given(found.where("n_hit = 0"), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with token ids and digests of ids and decoded text."""
    return bpe.encode(docs, vocabulary(), scratch=materialize, digested=True)


STAGES = [
    ("language_id", language), ("line_dedup", lines), ("near_dedup", near_duplicates), ("decontaminate", benchmark), ("bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
