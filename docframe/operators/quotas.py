"""Usage quotas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.operators.ordered import sql, top_per_key

KINDS = ("queries", "papers", "images")


@dataclass(frozen=True)
class Limits:
    queries: int = 10
    papers: int = 2
    images: int = 2
    ttl_hours: int = 72


def quota_snapshot(sessions: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Used, limit and remaining per kind."""
    cols = []
    for k in KINDS:
        n = getattr(limits, k)
        cols += [f"{k}_used", f"{n} AS {k}_limit", f"greatest(0, {n} - {k}_used) AS {k}_remaining"]
    return sessions.selectExpr("session_id", *cols, "expires_at")


def open_sessions(requests: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One session per id from its first request, with zero counters and an expiry."""
    hours = max(1, limits.ttl_hours)
    return requests.groupBy("session_id").agg(F.min("ts").alias("created_at")).selectExpr(
        "session_id", "concat('guest-', session_id) AS user_id", *[f"0L AS {k}_used" for k in KINDS],
        f"created_at + INTERVAL {hours} HOURS AS expires_at",
    )


def admit(requests: DataFrame, sessions: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Decide every request in order (U2): ``request_id, session_id, ts, queries, papers, images``.

    Adds ``admitted`` and ``rejected_for`` (the first short kind, or why the session is
    refused). A request takes all its kinds or nothing. What remains only shrinks, so the
    admitted requests with one demand are always the earliest with that demand, and there
    can be no more of them than the limits allow. The fold therefore sees only that many
    per session and demand; every other request is judged against the fold's cut-off.
    """
    lim = {k: getattr(limits, k) for k in KINDS}
    demand = "(queries > 0 OR papers > 0 OR images > 0)"
    valid = "(queries >= 0 AND papers >= 0 AND images >= 0)"
    live = requests.join(sessions.selectExpr("session_id", "expires_at", *[f"{k}_used" for k in KINDS]), "session_id").filter(
        f"ts < expires_at AND {valid} AND {demand}"
    )
    fits = " AND ".join(f"{k} <= {lim[k]} - {k}_used" for k in KINDS)
    most = max(lim.values())
    first = top_per_key(live.filter(fits), ["session_id", *KINDS], most, "ts, request_id")
    ident = requests.schema["request_id"].dataType.simpleString()
    state = f"struct<queries:bigint,papers:bigint,images:bigint,taken:array<struct<ts:timestamp,id:{ident},queries:int,papers:int,images:int>>>"
    room = " AND ".join(f"r.{k} <= a.{k}" for k in KINDS)
    folded = sql(
        f"""
        SELECT session_id, aggregate(
          array_sort(collect_list(named_struct('ts', ts, 'id', request_id, 'queries', CAST(queries AS INT),
            'papers', CAST(papers AS INT), 'images', CAST(images AS INT)))),
          CAST(named_struct({', '.join(f"'{k}', {lim[k]} - max({k}_used)" for k in KINDS)}, 'taken', array()) AS {state}),
          (a, r) -> IF({room}, CAST(named_struct({', '.join(f"'{k}', a.{k} - r.{k}" for k in KINDS)},
            'taken', concat(a.taken, array(r))) AS {state}), a)) AS st
        FROM {{f}} GROUP BY session_id
        """,
        f=first,
    )
    # What was left when a demand was first refused names the kind that ran short.
    taken = folded.selectExpr("session_id", "inline(st.taken)")
    cut = taken.groupBy("session_id", *KINDS).agg(F.expr("max(named_struct('ts', ts, 'id', id)) AS cut"))
    flow = folded.selectExpr("session_id", "st.taken AS taken")
    used = ", ".join(
        f"{k}_used + aggregate(filter(taken, t -> t.ts < ts0 OR (t.ts = ts0 AND t.id < id0)), 0L, (a, t) -> a + t.{k}) AS __{k}" for k in KINDS
    )
    return sql(
        f"""
        WITH judged AS (
          SELECT r.*, s.session_id IS NULL AS unknown, coalesce(r.ts >= s.expires_at, false) AS expired,
            NOT r.__demand OR coalesce(named_struct('ts', r.ts, 'id', r.request_id) <= c.cut, false) AS fits,
            {', '.join(f"coalesce(s.{k}_used, 0L) AS {k}_used" for k in KINDS)},
            coalesce(f.taken, array()) AS taken, r.ts AS ts0, r.request_id AS id0
          FROM {{r}} r LEFT JOIN {{s}} s ON r.session_id = s.session_id
          LEFT JOIN {{c}} c ON r.session_id = c.session_id AND {' AND '.join(f'r.{k} = c.{k}' for k in KINDS)}
          LEFT JOIN {{f}} f ON r.session_id = f.session_id),
        seen AS (SELECT *, {used} FROM judged)
        SELECT {', '.join(requests.columns)}, NOT unknown AND NOT expired AND __valid AND fits AS admitted,
          CASE WHEN NOT __valid THEN 'invalid' WHEN unknown THEN 'unknown_session' WHEN expired THEN 'expired' WHEN fits THEN NULL
            {' '.join(f"WHEN {k} > 0 AND {lim[k]} - __{k} < {k} THEN '{k}'" for k in KINDS)} END AS rejected_for
        FROM seen
        """,
        r=requests.selectExpr("*", f"{demand} AS __demand", f"{valid} AS __valid"),
        s=sessions,
        c=cut,
        f=flow,
    )


def charge(sessions: DataFrame, decided: DataFrame) -> DataFrame:
    """Sessions with the admitted requests added to their counters."""
    spent = decided.filter("admitted").groupBy("session_id").agg(*[F.sum(k).alias(f"__{k}") for k in KINDS])
    return sessions.join(spent, "session_id", "left").selectExpr(
        *[
            f"{c} + coalesce(__{c[:-5]}, 0) AS {c}" if c.endswith("_used") else c
            for c in sessions.columns
        ]
    )
