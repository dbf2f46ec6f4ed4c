"""Keyed quota state over several batches against the batch operator and a plain fold."""

import datetime as dt

from docframe.operators import quotas as qt
from docframe.streaming import jobs, quota_state

SCHEMA = "request_id long, session_id string, ts timestamp, queries int, papers int, images int"
START = dt.datetime(2024, 1, 1)


def at(hours):
    return START + dt.timedelta(hours=hours)


def run(spark, tmp_path, batches, limits=qt.Limits(), name="a"):
    for n, batch in enumerate(batches):  # files are read in the order of their times
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/{name}/in/{n}")
    feed = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/in/*")
    writer = quota_state.admit_stream(feed, limits).writeStream.option("checkpointLocation", f"{tmp_path}/{name}/log")
    jobs.run_once(writer.foreachBatch(lambda b, i: b.write.mode("append").parquet(f"{tmp_path}/{name}/out")))
    return {r.request_id: (r.admitted, r.rejected_for) for r in spark.read.parquet(f"{tmp_path}/{name}/out").collect()}


def test_three_batches_with_an_expired_session(spark, tmp_path):
    batches = [
        [(1, "a", at(0), 6, 0, 0), (2, "a", at(1), 5, 0, 0), (3, "b", at(1), 1, 1, 0), (4, "b", at(2), 0, 2, 0), (5, "c", at(0), -1, 0, 0)],
        [(6, "a", at(3), 4, 1, 1), (7, "a", at(4), 1, 0, 0), (8, "a", at(5), 0, 1, 2), (9, "d", at(140), 1, 0, 0)],
        [(10, "a", at(141), 0, 1, 0), (11, "d", at(142), 10, 0, 0), (12, "d", at(143), 9, 0, 0), (13, "b", at(150), 1, 0, 0)],
    ]
    rows = [r for b in batches for r in b]
    every = spark.createDataFrame(rows, SCHEMA)
    want = {r.request_id: (r.admitted, r.rejected_for) for r in qt.admit(every, qt.open_sessions(every)).collect()}
    got = run(spark, tmp_path, batches)
    assert got == want
    assert got[10] == (False, "expired") and got[13] == (False, "expired") and got[11] == (False, "queries") and got[12] == (True, None)


def test_other_limits_and_ties(spark, tmp_path):
    batches = [[(i, "s", at(0), 1, 0, 0) for i in range(5, 0, -1)], [(i, "s", at(0), 1, 0, 0) for i in range(6, 9)]]
    got = run(spark, tmp_path, batches, qt.Limits(queries=6), "b")
    assert [k for k, v in sorted(got.items()) if v[0]] == [1, 2, 3, 4, 5, 6]


def test_a_busy_session_in_a_large_batch(spark, tmp_path):
    rows = [(i, "hot" if i % 3 else f"s{i}", at(i / 3600), 1, 0, 0) for i in range(20_000)]
    got = run(spark, tmp_path, [rows[:15_000], rows[15_000:]], name="c")
    assert len(got) == 20_000
    hot = [v for k, v in got.items() if k % 3]
    assert sum(v[0] for v in hot) == 10 and all(v == (True, None) for k, v in got.items() if k % 3 == 0)
