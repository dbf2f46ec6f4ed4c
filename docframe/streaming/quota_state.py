"""Quota decisions with the counters of a session as keyed state (T4)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docframe.operators.quotas import KINDS, Limits

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = ", ".join(f"{k} long" for k in KINDS) + ", expires_at long, open boolean"
HOUR = 3_600_000  # milliseconds


class _Session(StatefulProcessor):
    """Counters of one session; a timer at its expiry closes it and drops the counters."""

    def __init__(self, limits: Limits):
        self.limits = [getattr(limits, k) for k in KINDS]
        self.life = max(1, limits.ttl_hours) * HOUR

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.session.get() if self.session.exists() else None
        used, expires = (list(held[: len(KINDS)]), held[len(KINDS)]) if held else ([0] * len(KINDS), None)
        is_open = held[len(KINDS) + 1] if held else True
        for part in rows:
            part = part.sort_values(["ts", "request_id"], ignore_index=True)
            verdicts = []
            for at, *asked in zip(part["ts"].astype("datetime64[us]").astype("int64"), *(part[k] for k in KINDS)):
                if expires is None:  # the first request opens the session
                    expires = at // 1000 + self.life
                    self.handle.registerTimer(int(expires))
                verdicts.append(self._decide(used, asked, is_open and at < expires * 1000))
            out = part[["request_id", "session_id", "ts"]].copy()
            out["admitted"] = [v is None for v in verdicts]
            out["rejected_for"] = pd.Series(verdicts, dtype=object)
            yield out
        if expires is not None:
            self.session.update((*[int(u) for u in used], int(expires), bool(is_open)))

    def _decide(self, used: list[int], asked: list[int], alive: bool) -> str | None:
        """None if the request is admitted (its kinds are then taken), else why not."""
        if any(pd.isna(n) or n < 0 for n in asked):
            return "invalid"
        if not alive:
            return "expired"
        for i, kind in enumerate(KINDS):
            if asked[i] > 0 and self.limits[i] - used[i] < asked[i]:
                return kind
        for i, n in enumerate(asked):
            used[i] += int(n)
        return None

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.session.get()
        self.session.update((*[0] * len(KINDS), held[len(KINDS)], False))
        return iter(())

    def close(self) -> None:
        pass


def admit_stream(requests: DataFrame, limits: Limits = Limits(), delay: str | None = None) -> DataFrame:
    """Decisions on a stream of ``request_id, session_id, ts, queries, papers, images`` (T4), in
    append mode: ``request_id, session_id, ts, admitted, rejected_for``.

    Each session is a key of Spark's state store with its counters; a batch loads and changes
    the sessions of its own requests only. Across batches the order of arrival decides, inside
    one the order of (ts, request_id) of each Arrow chunk of a session. Event time closes a
    session at its expiry: the timer drops the counters and leaves the mark by which later
    requests are refused. ``delay`` is the watermark's (by default the life of a session);
    Spark gives requests older than the watermark no decision.
    """
    spark = requests.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)  # keyed state needs it
    kinds = [F.col(k).cast("long").alias(k) for k in KINDS]
    marked = requests.select("request_id", "session_id", F.col("ts").cast("timestamp").alias("ts"), *kinds).withWatermark("ts", delay or f"{max(1, limits.ttl_hours)} hours")
    types = dict(marked.dtypes)
    return marked.groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=_Session(limits),
        outputStructType=f"request_id {types['request_id']}, session_id {types['session_id']}, ts timestamp, admitted boolean, rejected_for string",
        outputMode="Append",
        timeMode="EventTime",
    )
