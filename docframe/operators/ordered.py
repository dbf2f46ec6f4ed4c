"""Order-dependent computations that survive one very large group.

A window partitioned by the document alone would send a document that holds a
third of all rows through one task. Everything here works in two steps instead:
rows are windowed inside (group, block) where a block is a fixed span of the
integer order column, and the few per-block summaries carry the running value
from block to block. The order column must be an integer, unique in its group.
Expressions are SQL text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

BLOCK_ROWS = 4096


def sql(statement: str, **tables: DataFrame) -> DataFrame:
    """Run a statement over DataFrames named in braces."""
    spark = next(iter(tables.values())).sparkSession
    return spark.sql(statement, **tables)


def _list(names: Sequence[str], prefix: str = "") -> str:
    return ", ".join(f"{prefix}`{n}`" for n in names)


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    *,
    sums: dict[str, str] | None = None,
    lasts: dict[str, str] | None = None,
    before: dict[str, str] | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add running columns per group in order.

    ``sums``: running sum up to and including the row. ``lasts``: last non-null
    value up to the row. ``before``: last non-null value strictly before it.
    """
    sums, lasts, before = sums or {}, lasts or {}, before or {}
    todo = [(n, "sum", e) for n, e in sums.items()]
    todo += [(n, "last", e) for n, e in lasts.items()]
    todo += [(n, "before", e) for n, e in before.items()]
    taken = {n for n, _, _ in todo}
    base = [c for c in df.columns if c not in taken]
    k, o = _list(keys), f"`{order}`"
    work = df.selectExpr(
        *[f"`{c}`" for c in base],
        f"floor({o} / {block_rows}) AS __blk",
        *[f"({e}) AS `__v_{n}`" for n, _, e in todo],
    )
    totals = ", ".join(
        f"sum(`__v_{n}`) AS `__b_{n}`"
        if kind == "sum"
        else f"max_by(`__v_{n}`, IF(`__v_{n}` IS NULL, NULL, {o})) AS `__b_{n}`"
        for n, kind, _ in todo
    )
    carries = ", ".join(
        (f"sum(`__b_{n}`)" if kind == "sum" else f"last(`__b_{n}`, true)")
        + f" OVER (PARTITION BY {k} ORDER BY __blk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS `__c_{n}`"
        for n, kind, _ in todo
    )
    inner = ", ".join(
        (f"sum(`__v_{n}`)" if kind == "sum" else f"last(`__v_{n}`, true)")
        + f" OVER (PARTITION BY {k}, __blk ORDER BY {o} ROWS BETWEEN UNBOUNDED PRECEDING AND "
        + ("1 PRECEDING" if kind == "before" else "CURRENT ROW")
        + f") AS `__w_{n}`"
        for n, kind, _ in todo
    )
    final = ", ".join(
        f"coalesce(`__w_{n}`, 0) + coalesce(`__c_{n}`, 0) AS `{n}`"
        if kind == "sum"
        else f"coalesce(`__w_{n}`, `__c_{n}`) AS `{n}`"
        for n, kind, _ in todo
    )
    return sql(
        f"""
        WITH totals AS (SELECT {k}, __blk, {totals} FROM {{w}} GROUP BY {k}, __blk),
        carry AS (SELECT {k}, __blk, {carries} FROM totals),
        rows AS (SELECT *, {inner} FROM {{w}})
        SELECT {_list(base)}, {final} FROM rows LEFT JOIN carry USING ({k}, __blk)
        """,
        w=work,
    )


def number_rows(df: DataFrame, keys: Sequence[str], order: str, out: str) -> DataFrame:
    """1-based position of each row in its group."""
    return scan(df, keys, order, sums={out: "1L"})


def number_runs(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    *,
    run: str,
    start: str,
    sums: dict[str, str] | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Number consecutive runs of equal ``value`` and give each run's first order.

    Only the first and last value of a block and its count of inner changes are
    needed to join the blocks, so one summary pass suffices. ``sums``: running sums
    inside a run, up to and including the row; they need the sum of a block's last run too.
    """
    sums = sums or {}
    base = [c for c in df.columns if c not in (run, start, *sums)]
    k, o = _list(keys), f"`{order}`"
    blocks = f"PARTITION BY {k} ORDER BY __blk"
    inside = f"PARTITION BY {k}, __blk ORDER BY {o}"
    upto = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    prior = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    work = df.selectExpr(
        *[f"`{c}`" for c in base],
        f"floor({o} / {block_rows}) AS __blk",
        f"named_struct('v', {value}) AS __val",
        *[f"({e}) AS `__v_{n}`" for n, e in sums.items()],
    )
    # A block's last run begins a new sum where the value changes inside the block or at its edge.
    tails = "".join(f", sum(IF(__k = __all, `__v_{n}`, NULL)) AS `__t_{n}`" for n in sums)
    held = "".join(f", sum(`__t_{n}`) OVER (PARTITION BY {k}, __seg ORDER BY __blk {upto}) AS `__r_{n}`" for n in sums)
    carried = "".join(f", IF(__edge, NULL, lag(`__r_{n}`) OVER ({blocks})) AS `__c_{n}`" for n in sums)
    inner = "".join(f", sum(`__v_{n}`) OVER (PARTITION BY {k}, __blk, __k ORDER BY {o} {upto}) AS `__w_{n}`" for n in sums)
    final = "".join(f", coalesce(`__w_{n}`, 0) + IF(__k = 0, coalesce(`__c_{n}`, 0), 0) AS `{n}`" for n in sums)
    return sql(
        f"""
        WITH marked AS (
          SELECT *, coalesce(NOT (__val <=> lag(__val) OVER ({inside})), false)
            AND lag({o}) OVER ({inside}) IS NOT NULL AS __new FROM {{w}}),
        counted AS (
          SELECT *, count_if(__new) OVER ({inside} {upto}) AS __k, count_if(__new) OVER (PARTITION BY {k}, __blk) AS __all FROM marked),
        totals AS (
          SELECT {k}, __blk, min_by(__val, {o}) AS __first, max_by(__val, {o}) AS __last, min({o}) AS __lo,
            max(IF(__new, {o}, NULL)) AS __chg, count_if(__new) AS __n{tails} FROM counted GROUP BY {k}, __blk),
        edged AS (
          SELECT *, NOT (__first <=> lag(__last) OVER ({blocks})) AS __edge FROM totals),
        segments AS (
          SELECT *, count_if(__edge OR __n > 0) OVER ({blocks} {upto}) AS __seg FROM edged),
        edges AS (SELECT *{held} FROM segments),
        carry AS (
          SELECT {k}, __blk{carried},
            count_if(__edge) OVER ({blocks} {upto}) + coalesce(sum(__n) OVER ({blocks} {prior}), 0) AS __offset,
            IF(__edge, __lo, last(coalesce(__chg, IF(__edge, __lo, NULL)), true) OVER ({blocks} {prior})) AS __start
          FROM edges),
        rows AS (
          SELECT *, last(IF(__new, {o}, NULL), true) OVER ({inside} {upto}) AS __s{inner} FROM (
            SELECT *, count_if(__new) OVER ({inside} {upto}) AS __k FROM marked))
        SELECT {_list(base)}, __k + __offset AS `{run}`, coalesce(__s, __start) AS `{start}`{final}
        FROM rows LEFT JOIN carry USING ({k}, __blk)
        """,
        w=work,
    )


def top_per_key(
    df: DataFrame, keys: Sequence[str], n: int, order: str, rank: str | None = None
) -> DataFrame:
    """First ``n`` rows per key. The ``row_number() <= n`` filter is applied before the
    shuffle too (group limit), so a hot key sends at most n rows per map task."""
    name = rank or "__rn"
    out = df.selectExpr(
        "*", f"row_number() OVER (PARTITION BY {_list(keys)} ORDER BY {order}) AS `{name}`"
    ).filter(f"`{name}` <= {int(n)}")
    return out if rank else out.drop(name)


def first_per_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    return top_per_key(df, keys, 1, order)


def in_order(order: str, value: str) -> str:
    """Aggregate over a bounded group: array of values in order."""
    return (
        f"transform(array_sort(collect_list(named_struct('o', {order}, 'v', {value}))), p -> p.v)"
    )


def join_in_order(order: str, value: str, sep: str) -> str:
    """Aggregate over a bounded group: texts joined in order."""
    return f"array_join({in_order(order, value)}, {sep})"
