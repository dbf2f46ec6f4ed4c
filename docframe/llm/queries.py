"""Registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.llm import (
    alignment, bpe, decontaminate, language_id, line_dedup, near_dedup, nearest, secret_scan, sharding, substring_dedup, token_counts,
    url_filter, whitening,
)
from docframe.llm.sql import URL_REPUTATION
from docframe.session import materialize

SHARDS = 24
NEIGHBOURS = 20
VOCABULARY = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
RANKS = "byte_bpe_multi_50k.tiktoken"
RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]


@functools.cache
def content(name: str) -> bytes:
    """Content of a vocabulary file of the installed package."""
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def vocabulary(name: str = VOCABULARY) -> str:
    return content(name).decode()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out().alias("held_out"))
    learned = language_id.learn(docs.where("NOT held_out"))
    return language_id.classify(docs.drop("lang"), learned).drop("text")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = substring_dedup.remove_repeats(docs, materialize)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    host, _ = url_filter.host_and_path(F.col("url"))
    labelled = pages.join(labels, "page_id").select(host.alias("host"), "bad")
    return url_filter.judge(pages, url_filter.reputation(labelled, materialize), RULES).select(
        "page_id", "host", "path", "rule", "verdict", "bad_share", "bad_bound"
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard(docs, SHARDS, materialize).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens"
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = line_dedup.repeats(docs, materialize)
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n")))
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("doc"), n_lines.cast("long").alias("n_lines"))
    none = "CAST(array() AS array<int>)"
    return rows.join(found, "doc", "left").selectExpr(
        "doc_id", "n_lines", f"coalesce(exact, {none}) AS exact_lines", f"coalesce(near, {none}) AS near_lines",
        "CAST(coalesce(size(exact) + size(near), 0) AS BIGINT) AS n_removed",
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, token_counts.byte_pieces(vocabulary())).drop("text")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.encode(docs, vocabulary(), scratch=materialize, digested=True)
    return encoded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest.search(vectors, vectors.where("vec_id % 20 = 0"), NEIGHBOURS, materialize)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents").select("doc_id", "text"), materialize).drop("text_hash")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return decontaminate.decontaminate(docs, items, materialize).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", materialize)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.align_corpus(docs, alignment.Vocabularies(vocabulary(), content(PIECES)), materialize)


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secret_scan.scan(docs, content(RANKS)).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_random"
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_substring_dedup, op3_url_filter, op4_sharding, op5_line_dedup, op6_token_counts, op7_bpe,
        op8_nearest, op9_near_dedup, op10_decontaminate, op11_whitening, op12_alignment, op13_secret_scan,
    )
}

ORACLES = {"op3_url_filter": URL_REPUTATION}
