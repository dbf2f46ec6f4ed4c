"""Document tables by versions."""

import pytest

from docframe.session import scratch_path
from docframe.sources.versioned import DocumentStore, committed
from docframe.streaming import jobs


def rows(spark, papers, n):
    return spark.createDataFrame([(p, i, n) for p in papers for i in range(2)], "paper_id string, i int, n int")


def papers(spark, names):
    return spark.createDataFrame([(p,) for p in names], "paper_id string")


def held(store, table="a", number=None):
    return {(r.paper_id, r.n) for r in store.read(table, number).collect()}


def test_versions(spark):
    store = DocumentStore(scratch_path(spark, "store"), spark)
    with pytest.raises(ValueError):
        store.read("a")
    assert store.commit(0, papers(spark, "xyz"), {"a": rows(spark, "xyz", 0), "b": rows(spark, "xy", 0)})
    assert store.commit(1, papers(spark, "yw"), {"a": rows(spark, "yw", 1), "b": rows(spark, "", 1)})
    want = {("x", 0), ("z", 0), ("y", 1), ("w", 1)}
    assert held(store) == want and held(store, "b") == {("x", 0)}
    assert not store.commit(1, papers(spark, "x"), {"a": rows(spark, "x", 9)})  # a repeated batch
    assert held(store) == want
    store.compact()
    assert held(store) == want and store.read("a").count() == 8 and len(store.version().batches) == 1
    assert held(store, number=1) == {("x", 0), ("y", 0), ("z", 0)}  # earlier versions stay
    assert store.commit(2, papers(spark, "x"), {"a": rows(spark, "", 2)})
    assert held(store) == want - {("x", 0)} and held(store, "b") == set()


def test_a_batch_counts_only_as_a_whole(spark, monkeypatch):
    store = DocumentStore(scratch_path(spark, "store"), spark)
    store.commit(0, papers(spark, "xy"), {"a": rows(spark, "xy", 0), "b": rows(spark, "xy", 0)})

    class Broken:
        @property
        def write(self):
            raise OSError("lost")

    with pytest.raises(OSError):  # table a is written, b is not
        store.commit(1, papers(spark, "x"), {"a": rows(spark, "x", 1), "b": Broken()})
    assert held(store) == held(store, "b") == {("x", 0), ("y", 0)}
    store.commit(1, papers(spark, "x"), {"a": rows(spark, "x", 2), "b": rows(spark, "x", 2)})
    assert held(store) == held(store, "b") == {("x", 2), ("y", 0)}


def test_stream_of_several_batches(spark, tmp_path):
    schema = "paper_id string, i int, n int"
    for k, names in enumerate(["xy", "yz", "x", "w"]):
        rows(spark, names, k).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    store = DocumentStore(f"{tmp_path}/store", spark)
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    take = committed(store, lambda b: (b.select("paper_id"), {"a": b}), every=2)
    jobs.run_once(feed.writeStream.option("checkpointLocation", f"{tmp_path}/log").foreachBatch(take))
    assert held(store) == {("y", 1), ("z", 1), ("x", 2), ("w", 3)}
    assert len(store.version().batches) <= 2 and store.version().last == 3
