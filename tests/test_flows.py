"""Streams over given tables."""

from docframe.plans import flows
from docframe.plans.catalog import QUERIES


def test_tables_of_several_files(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"Text {i % 4}") for i in range(12)], "doc_id long, text string")
    rows.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "<b>sk-12345678</b>"), (2, None)], "page_id long, html string").repartition(2).write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(r.identity for r in QUERIES["dedupe_stream"](spark, str(tmp_path)).collect()) == [f"text {i}" for i in range(4)]
    assert sorted(r.page_id for r in QUERIES["guard_stream"](spark, f"{tmp_path}/").collect()) == [1, 2]


def test_table_of_one_file(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/t")
    next((tmp_path / "t").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    feed = flows.source_stream(spark, str(tmp_path), "documents")
    query = feed.writeStream.format("memory").queryName("one_file").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [tuple(r) for r in spark.table("one_file").collect()] == [(1, "a")]
