"""Greedy packing of ordered parts into chunks, in parallel and without a cut of its own.

A greedy packer is a walk: from the part a chunk starts with, the sizes that follow say
where the next chunk starts. Parts are dealt to blocks of a fixed span of running size,
each with a margin of the parts that a chunk from its end can still reach, so every
"next start" is known inside its block. A block is then summed up by a map from the few
parts at its beginning where a walk can enter to the part where it leaves and the number
of chunks between. Maps compose; they are composed in groups of ``FAN``, level by level,
and the entries are handed back down. The chunks are those of one walk over the whole
group whatever the span of a block, and no task holds more than a block or ``FAN`` maps.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.functions.text import solid_runs
from docframe.operators.ordered import scan, sql
from docframe.session import materialize

# Split points from coarse to fine.
SEPARATORS = ("\n\n", "\n", ". ", " ")
# Chunk limits in a block's span, and maps composed by one task.
SPAN = 32
FAN = 256
PART_BITS = 24  # a place is the element's order and the part inside the element
END = -1


def blank_tokens(text: str) -> int:
    """Runs of non-blank characters: the default measure of the recursive splitter."""
    return len(text.split())


def pack(parts: Sequence[str], glue: str, limit: int, overlap: int, length: Callable[[str], int]) -> list[str]:
    """Join neighbours up to ``limit``; the next chunk repeats a tail of at most ``overlap``."""
    sizes = [length(p) for p in parts]
    out, at = [], 0
    while at < len(parts):
        end, start = next_chunk(sizes, at, length(glue), limit, overlap)
        out.append(glue.join(parts[at:end]))
        at = start
    return out


def next_chunk(sizes: Sequence[int], at: int, gap: int, limit: int, overlap: int) -> tuple[int, int]:
    """End of the chunk that starts at part ``at`` and start of the next one."""
    held, end = sizes[at] + gap, at + 1  # each held part counts with the glue after it
    while end < len(sizes) and held + sizes[end] <= limit:
        held += sizes[end] + gap
        end += 1
    if end == len(sizes):
        return end, end
    start = at
    while start < end and (held - gap > overlap or held + sizes[end] > limit):
        held -= sizes[start] + gap
        start += 1
    return end, start


def split_text(
    text: str, limit: int, overlap: int, depth: int = 0, length: Callable[[str], int] = blank_tokens
) -> list[str]:
    """Chunks of at most ``limit`` by ``length``, cut at the coarsest separator that works.
    Every token is covered; only siblings at one depth are joined. Below the separators come
    other blanks, then characters (one that alone exceeds the limit is a chunk)."""
    if length(text) <= limit:
        return [text.strip()] if text.strip() else []
    if depth > len(SEPARATORS):
        return [c.strip() for c in pack(list(text), "", limit, overlap, length) if c.strip()]
    if depth == len(SEPARATORS):
        parts, glue = text.split(), " "
    else:
        sep = SEPARATORS[depth]
        parts = re.split(r"(?<=\.) ", text) if sep == ". " else text.split(sep)
        glue = " " if sep == ". " else sep
    out: list[str] = []
    run: list[str] = []
    for part in parts:
        if not part.strip():
            continue
        if length(part) <= limit:
            run.append(part)
            continue
        out += pack(run, glue, limit, overlap, length)
        run = []
        out += split_text(part, limit, overlap, depth + 1, length)
    out += pack(run, glue, limit, overlap, length)
    return [c.strip() for c in out if c.strip()]


class Walk:
    """Packing of the paragraphs of one block of elements (texts by order, margin included)."""

    def __init__(self, orders, texts, limit: int, overlap: int, length: Callable[[str], int]):
        self.limit, self.overlap, self.length = limit, overlap, length
        self.places, self.parts = [], []
        for order, text in zip(orders, texts):
            for i, part in enumerate((text or "").split(SEPARATORS[0])):
                if part.strip():
                    self.places.append((int(order) << PART_BITS) + i)
                    self.parts.append(part)
        self.sizes = [length(p) for p in self.parts]
        self.gap = length(SEPARATORS[0])

    def step(self, at: int) -> tuple[int, int, int]:
        """Chunk or chunks that start at part ``at``: end, next start, and their number."""
        if self.sizes[at] > self.limit:  # too large for a chunk: split by itself
            return at + 1, at + 1, len(split_text(self.parts[at], self.limit, self.overlap, 1, self.length))
        stop = at + 1
        total = 0
        while stop < len(self.sizes) and self.sizes[stop] <= self.limit and total <= self.limit:
            total += self.sizes[stop]
            stop += 1
        end, start = next_chunk(self.sizes[at:stop], 0, self.gap, self.limit, self.overlap)
        return at + end, at + start, 1

    def map(self, end_order: int, entries: int) -> list[tuple[int, int, int]]:
        """(entry, exit, chunks) for each of the first ``entries`` parts; an exit is the first start
        at or after ``end_order``, ``END`` if there is none."""
        last = end_order << PART_BITS
        inside = sum(p < last for p in self.places)
        exits, counts = [END] * len(self.places), [0] * len(self.places)
        for at in range(inside - 1, -1, -1):
            _, start, n = self.step(at)
            if start >= len(self.places):
                exits[at], counts[at] = END, n
            elif start >= inside:
                exits[at], counts[at] = self.places[start], n
            else:
                exits[at], counts[at] = exits[start], counts[start] + n
        return [(self.places[i], exits[i], counts[i]) for i in range(min(entries, inside))]

    def entries(self) -> int:
        """Parts where a walk from before can enter: those within a limit of the beginning."""
        total, n = 0, 0
        while n < len(self.sizes) and total <= self.limit:
            total += self.sizes[n] + self.gap
            n += 1
        return n

    def chunks(self, entry: int, end_order: int) -> list[tuple[str, int, int]]:
        """(content, first order, last order) of the chunks that start before ``end_order``."""
        if entry == END:
            return []
        at = next((i for i, p in enumerate(self.places) if p >= entry), len(self.places))
        out = []
        while at < len(self.places) and self.places[at] < end_order << PART_BITS:
            end, start, _ = self.step(at)
            first, last = self.places[at] >> PART_BITS, self.places[end - 1] >> PART_BITS
            if self.sizes[at] > self.limit:
                pieces = split_text(self.parts[at], self.limit, self.overlap, 1, self.length)
            else:
                pieces = [SEPARATORS[0].join(self.parts[at:end]).strip()]
            out += [(p, first, last) for p in pieces]
            at = start
        return out


_PIECES = "array<struct<content:string,ranges:array<struct<first:bigint,last:bigint>>>>"
_MAP = "array<struct<entry:bigint,exit:bigint,chunks:bigint>>"


def measured(elements: DataFrame, length: Callable[[str], int]) -> DataFrame:
    """Elements with ``n``, what their paragraphs measure with the glue after each, and ``w``,
    what their whole text does with one glue."""
    if length is blank_tokens:  # the glue measures nothing
        tokens = f"CAST(coalesce(size({solid_runs('text')}), 0) AS BIGINT)"
        return elements.selectExpr("*", f"{tokens} AS n").withColumn("w", F.col("n"))
    gap = length(SEPARATORS[0])

    @F.pandas_udf("n long, w long")
    def measure(texts: pd.Series) -> pd.DataFrame:
        n = texts.map(lambda t: sum(length(p) + gap for p in t.split(SEPARATORS[0]) if p.strip()) if t else 0)
        return pd.DataFrame({"n": n, "w": texts.map(lambda t: length(t) + gap if t else 0)})

    return elements.withColumn("m", measure("text")).select("*", "m.n", "m.w").drop("m")


def sized(elements: DataFrame, length: Callable[[str], int]) -> DataFrame:
    """Elements of a group (paper_id, group_no, order, text) as ``measured`` and with ``c``, the
    sum of ``n`` of the group's elements before them; those that have it are left as they are."""
    if "c" in elements.columns:
        return elements
    placed = scan(measured(elements, length), ["paper_id", "group_no"], "order", sums={"upto": "n"})
    return placed.withColumn("c", F.col("upto") - F.col("n")).drop("upto")


def _ranges(orders: Sequence[int], first: int, last: int) -> list[dict[str, int]]:
    """Runs of consecutive orders from ``first`` to ``last``."""
    out: list[dict[str, int]] = []
    for o in orders:
        if first <= o <= last:
            if out and out[-1]["last"] == o - 1:
                out[-1]["last"] = o
            else:
                out.append({"first": o, "last": o})
    return out


def _block_rows(placed: DataFrame, limit: int, span: int) -> DataFrame:
    """One row per (paper, group, block): own elements, the margin behind them, and what they measure."""
    width = span * limit
    own = placed.groupBy("paper_id", "group_no", F.expr(f"c DIV {width} AS block")).agg(
        F.expr("array_sort(collect_list(named_struct('o', order, 't', text))) AS own"),
        F.expr("min(c) AS c0"), F.expr("sum(w) AS whole"), F.expr("max(order) + 1 AS end_order"),
    )
    # Where blocks end follows from the sizes alone; the texts of a block are gathered once, below.
    ends = materialize(sql(
        """
        SELECT paper_id, group_no, block, lead(c0) OVER (PARTITION BY paper_id, group_no ORDER BY block) AS e
        FROM (SELECT paper_id, group_no, block, c0, max(block) OVER (PARTITION BY paper_id, group_no) AS top FROM {b}) WHERE top > 0
        """,
        b=own.select("paper_id", "group_no", "block", "c0"),
    ))
    margin = sql(
        f"""
        SELECT e.paper_id, e.group_no, e.block, array_sort(collect_list(named_struct('o', p.order, 't', p.text))) AS margin
        FROM (SELECT paper_id, group_no, block, e, explode(sequence(e DIV {width}, (e + {limit}) DIV {width})) AS at FROM {{e}} WHERE e IS NOT NULL) e
        JOIN {{p}} p ON p.paper_id = e.paper_id AND p.group_no = e.group_no AND p.c DIV {width} = e.at AND p.c BETWEEN e.e AND e.e + {limit}
        GROUP BY e.paper_id, e.group_no, e.block
        """,
        e=ends,
        p=placed.select("paper_id", "group_no", "order", "text", "c"),
    )
    return sql(
        """
        SELECT b.*, m.margin, e.block IS NOT NULL AS many FROM {b} b
        LEFT JOIN {m} m ON b.paper_id = m.paper_id AND b.group_no = m.group_no AND b.block = m.block
        LEFT JOIN {e} e ON b.paper_id = e.paper_id AND b.group_no = e.group_no AND b.block = e.block
        """,
        b=own,
        m=margin,
        e=ends,
    )


def _entries(maps: DataFrame) -> DataFrame:
    """Entry of every block and the number of chunks before it, from the maps of the blocks:
    composed level by level until ``FAN`` are left in a group, and handed back down."""
    levels = [maps]
    while levels[-1].agg(F.max("idx")).first()[0] >= FAN:
        levels.append(materialize(_grouped(levels[-1]).select("paper_id", "group_no", F.col("up").alias("idx"), _compose()("maps").alias("c")).select(
            "paper_id", "group_no", "idx", "c.end", "c.map")))
    given = levels[-1].groupBy("paper_id", "group_no").agg(F.lit(0).cast("long").alias("up")).withColumns(
        {"entry": F.lit(0).cast("long"), "base": F.lit(0).cast("long")})
    for level in reversed(levels):
        rows = _grouped(level).join(given, ["paper_id", "group_no", "up"])
        inner = rows.select("paper_id", "group_no", "base", F.inline(_followed()("maps", "entry")))
        given = materialize(inner.select("paper_id", "group_no", F.col("idx").alias("up"), "entry", (F.col("base") + F.col("before")).alias("base")))
    return given.withColumnRenamed("up", "idx")


def _grouped(level: DataFrame) -> DataFrame:
    """Maps in groups of ``FAN``."""
    return level.groupBy("paper_id", "group_no", F.expr(f"idx DIV {FAN} AS up")).agg(
        F.expr("array_sort(collect_list(named_struct('idx', idx, 'end', end, 'map', map))) AS maps")
    )


def follow(maps: Sequence[dict], entry: int) -> tuple[list[tuple[int, int, int]], int, int]:
    """(index, entry, chunks before) of every map for a walk that enters at ``entry``, where it
    leaves the last one, and its number of chunks. The first start of a group is entry 0."""
    steps, total = [], 0
    for m in maps:
        steps.append((m["idx"], entry, total))
        found = next((x for x in m["map"] if x["entry"] >= entry), None)
        if entry == END or entry >= m["end"] or found is None:  # the walk passes the block by
            continue
        entry, total = found["exit"], total + found["chunks"]
    return steps, entry, total


def _compose():
    @F.pandas_udf(f"end bigint, map {_MAP}")
    def compose(groups: pd.Series) -> pd.DataFrame:
        rows = []
        for maps in groups:
            # A chunk can pass by one short block at most, so a walk enters the first block or the second.
            starts = [x["entry"] for m in maps[:2] for x in m["map"]]
            found = []
            for entry in starts:
                _, exit_, n = follow(maps, entry)
                found.append({"entry": entry, "exit": exit_, "chunks": n})
            rows.append((maps[-1]["end"], found))
        return pd.DataFrame(rows, columns=["end", "map"])

    return compose


def _followed():
    @F.pandas_udf("array<struct<idx:bigint,entry:bigint,before:bigint>>")
    def followed(groups: pd.Series, entries: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("idx", "entry", "before"), s)) for s in follow(maps, e)[0]] for maps, e in zip(groups, entries)])

    return followed


def pack_groups(
    elements: DataFrame, limit: int, overlap: int = 0, length: Callable[[str], int] = blank_tokens, span: int = SPAN
) -> DataFrame:
    """Chunks of every group: ``paper_id, group_no, block, no`` (from 0 in the group), ``content`` and
    ``ranges`` of the element orders it holds. A group that measures no more than the limit is one
    chunk with its text unchanged. ``span`` changes no result."""
    stored = elements if "c" in elements.columns else materialize(sized(elements, length))
    rows = materialize(_block_rows(stored, limit, span))

    def walk(own, margin) -> Walk:
        every = [*own, *(margin if margin is not None else ())]
        return Walk([x["o"] for x in every], [x["t"] for x in every], limit, overlap, length)

    @F.pandas_udf(f"end bigint, map {_MAP}")
    def map_of(own: pd.Series, margin: pd.Series, end: pd.Series) -> pd.DataFrame:
        found = []
        for o, m, e in zip(own, margin, end):
            w = walk(o, m)
            found.append((e << PART_BITS, [dict(zip(("entry", "exit", "chunks"), x)) for x in w.map(e, w.entries())]))
        return pd.DataFrame(found, columns=["end", "map"])

    @F.pandas_udf(_PIECES)
    def pieces_of(own: pd.Series, margin: pd.Series, end: pd.Series, entry: pd.Series, whole: pd.Series) -> pd.Series:
        out = []
        for o, m, e, at, is_whole in zip(own, margin, end, entry, whole):
            orders = [x["o"] for x in [*o, *(m if m is not None else ())]]
            if is_whole:
                text = SEPARATORS[0].join(x["t"] for x in o if x["t"]).strip()
                chunks = [(text, orders[0], orders[-1])] if text else []
            else:
                chunks = walk(o, m).chunks(int(at), e)
            out.append([{"content": c, "ranges": _ranges(orders, a, z)} for c, a, z in chunks])
        return pd.Series(out)

    many = rows.where("many")
    keys = ["paper_id", "group_no"]
    alone = rows.where("NOT many").withColumns({"entry": F.lit(0).cast("long"), "base": F.lit(0).cast("long")})
    if many.limit(1).count():
        numbered = many.withColumn("idx", F.expr("row_number() OVER (PARTITION BY paper_id, group_no ORDER BY block) - 1").cast("long"))
        places = materialize(numbered.select(*keys, "block", "idx"))
        maps = many.join(places, [*keys, "block"]).select(*keys, "idx", map_of("own", "margin", "end_order").alias("m")).select(*keys, "idx", "m.end", "m.map")
        entered = places.join(_entries(materialize(maps)), [*keys, "idx"]).drop("idx")
        alone = alone.unionByName(many.join(entered, [*keys, "block"]))
    whole = F.expr(f"NOT many AND whole <= {limit + length(SEPARATORS[0])}")
    cut = alone.select(*keys, "block", "base", pieces_of("own", "margin", "end_order", "entry", whole).alias("pieces"))
    return cut.select(*keys, "block", "base", F.posexplode("pieces").alias("pos", "p")).selectExpr(
        *keys, "block", "base + pos AS no", "p.content AS content", "p.ranges AS ranges"
    )


def cut_windows(elements: DataFrame, limit: int, overlap: int = 0) -> DataFrame:
    """As ``pack_groups``, with windows of ``limit`` blank-separated tokens every ``limit - overlap``.
    Windows follow from the running count of tokens alone; each is put together by itself."""
    step = limit - overlap
    placed = sized(elements, blank_tokens).withColumn("toks", F.expr(solid_runs("text"))).where("n > 0")
    first = f"IF(c < {limit}, 0L, (c - {limit}) DIV {step} + 1)"
    parts = placed.selectExpr("paper_id", "group_no", "order", "toks", "c", "n", f"explode(sequence({first}, (c + n - 1) DIV {step})) AS no")
    low, high = f"greatest(no * {step}, c)", f"least(no * {step} + {limit}, c + n)"
    # Tokens hold no blank, so they are moved as one text, which takes less room than a list.
    parts = parts.where(f"{high} > {low}").selectExpr(
        "paper_id", "group_no", "no", "order", f"{high} - {low} AS held",
        f"array_join(slice(toks, CAST({low} - c + 1 AS INT), CAST({high} - {low} AS INT)), ' ') AS piece",
    )
    # Dealt by block, so that facts of a block meet its windows without another exchange.
    dealt = parts.withColumn("block", F.expr(f"no DIV {SPAN}")).repartition("paper_id", "group_no", "block")
    windows = dealt.groupBy("paper_id", "group_no", "block", "no").agg(
        F.expr("array_join(transform(array_sort(collect_list(named_struct('o', order, 't', piece))), x -> x.t), ' ') AS content"),
        F.expr("array_sort(collect_list(order)) AS orders"),
        F.expr("sum(held) AS held"),
    )
    # A last window that only repeats the overlap is none.
    merged = """aggregate(orders, CAST(array() AS array<struct<first:bigint,last:bigint>>), (a, o) ->
        IF(size(a) > 0 AND element_at(a, -1).last = o - 1,
          concat(slice(a, 1, size(a) - 1), array(named_struct('first', element_at(a, -1).first, 'last', o))),
          concat(a, array(named_struct('first', o, 'last', o)))))"""
    return windows.where(f"no = 0 OR held > {overlap}").selectExpr(
        "paper_id", "group_no", "block", "no", "content", f"{merged} AS ranges"
    )
