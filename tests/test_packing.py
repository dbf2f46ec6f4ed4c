"""Parallel packing against one walk over each whole group."""

import random

import pytest

from docframe.operators import chunking as ck
from docframe.operators import packing

SCHEMA = "paper_id string, group_no long, order long, text string"


def groups(rng):
    """Elements of groups of all sizes, with paragraphs, large parts, blanks and gaps in the orders."""
    rows = []
    for paper in ("a", "b"):
        order = 0
        for group in range(1, 30):
            for _ in range(rng.choice([1, 2, 5, 60])):
                order += rng.choice([1, 1, 1, 3])
                kind = rng.random()
                if kind < 0.05:
                    text = " ".join(f"big{order}x{i}" for i in range(rng.randrange(10, 90)))
                elif kind < 0.2:
                    text = "\n\n".join(f"p{order}y{i} z" for i in range(rng.randrange(2, 14)))
                elif kind < 0.25:
                    text = rng.choice(["", "  ", None])
                else:
                    text = " ".join(f"w{order}n{i}" for i in range(rng.randrange(1, 6)))
                rows.append((paper, group, order, text))
    return rows


def one_walk(rows, limit, overlap, length):
    """Chunks of each group from its whole text at once."""
    out = {}
    for key in sorted({r[:2] for r in rows}):
        texts = [t for p, g, _, t in rows if (p, g) == key and t]
        text = "\n\n".join(texts)
        if length(text) <= limit:
            out[key] = [text.strip()] if text.strip() else []
            continue
        chunks, run = [], []
        for part in text.split("\n\n"):
            if not part.strip():
                continue
            if length(part) <= limit:
                run.append(part)
                continue
            chunks += packing.pack(run, "\n\n", limit, overlap, length) + packing.split_text(part, limit, overlap, 1, length)
            run = []
        out[key] = [c.strip() for c in chunks + packing.pack(run, "\n\n", limit, overlap, length)]
    return {k: v for k, v in out.items() if v}


def collected(df):
    out = {}
    for r in df.orderBy("paper_id", "group_no", "no").collect():
        found = out.setdefault((r.paper_id, r.group_no), [])
        assert r.no == len(found)
        found.append(r.content)
    return out


@pytest.mark.parametrize("limit, overlap, length", [(12, 0, packing.blank_tokens), (12, 5, packing.blank_tokens), (40, 0, len), (55, 20, len)])
def test_blocks_of_any_span_give_the_chunks_of_one_walk(spark, monkeypatch, limit, overlap, length):
    rows = groups(random.Random(limit + overlap))
    df = spark.createDataFrame(rows, SCHEMA)
    want = one_walk(rows, limit, overlap, length)
    assert sum(map(len, want.values())) > 100
    for span, fan in ((1, 2), (2, 3), (packing.SPAN, 256)):
        monkeypatch.setattr(packing, "FAN", fan)
        assert collected(packing.pack_groups(df, limit, overlap, length, span)) == want, (span, fan)


def test_earlier_packing_rule():
    """The walk packs as a queue that drops its head until the next part fits does."""
    rng = random.Random(1)
    for _ in range(300):
        sizes = [rng.randrange(1, 9) for _ in range(rng.randrange(1, 30))]
        parts = [("x " * n).strip() + f"#{i}" for i, n in enumerate(sizes)]
        limit, overlap = 10, rng.randrange(0, 7)
        out, held, size = [], [], 0
        for p in parts:
            n = len(p.split())
            if held and size + n > limit:
                out.append("|".join(held))
                while held and (size > overlap or size + n > limit):
                    size -= len(held.pop(0).split())
            held.append(p)
            size += n
        out.append("|".join(held))
        packed = packing.pack(parts, "", limit, overlap, packing.blank_tokens)
        assert packed == [c.replace("|", "") for c in out]


def test_fixed_windows(spark):
    rows = groups(random.Random(3))
    df = spark.createDataFrame(rows, SCHEMA)
    for limit, overlap in ((7, 0), (12, 5)):
        want = {}
        for key in {r[:2] for r in rows}:
            toks = " ".join(t for p, g, _, t in rows if (p, g) == key and t).split()
            starts = range(0, max(len(toks) - overlap, 1), limit - overlap)
            if toks:
                want[key] = [" ".join(toks[s : s + limit]) for s in starts]
        assert collected(packing.cut_windows(df, limit, overlap)) == want


def test_ranges_name_the_elements_of_a_chunk(spark):
    rows = [("p", 1, o, f"t{o} u{o}") for o in (1, 2, 5, 6, 9)]
    got = packing.pack_groups(spark.createDataFrame(rows, SCHEMA), 6).orderBy("no").collect()
    assert [[(x["first"], x["last"]) for x in r.ranges] for r in got] == [[(1, 2), (5, 5)], [(6, 6), (9, 9)]]
    fixed = packing.cut_windows(spark.createDataFrame(rows, SCHEMA), 5).orderBy("no").collect()
    assert [[(x["first"], x["last"]) for x in r.ranges] for r in fixed] == [[(1, 2), (5, 5)], [(5, 6), (9, 9)]]


def test_orphans_are_what_no_range_covers(spark):
    elements = spark.createDataFrame([("p", i, f"e{i}") for i in range(1, 9)] + [("q", 1, "e1")], "paper_id string, order long, element_id string")
    chunks = spark.createDataFrame(
        [("p", ck.PARENT, [(1, 2), (5, 5)]), ("p", ck.PARENT, [(2, 3)]), ("p", "text", [(8, 8)]), ("r", ck.PARENT, [(1, 4)])],
        "paper_id string, chunk_type string, element_ranges array<struct<first:bigint,last:bigint>>",
    )
    got = ck.orphaned_elements(elements, chunks)
    assert sorted((r.paper_id, r.order, r.element_id) for r in got.collect()) == [("p", 4, "e4"), ("p", 6, "e6"), ("p", 7, "e7"), ("p", 8, "e8"), ("q", 1, "e1")]
    assert "Generate explode" not in got._jdf.queryExecution().executedPlan().toString()


def test_one_huge_group_is_numbered_through(spark, monkeypatch):
    monkeypatch.setattr(packing, "SPAN", 2)
    rows = [("p", o, f"e{o}", f"a{o} b{o} c{o}", 1 + o // 50, ["s"] if o > 3 else []) for o in range(1, 400)]
    schema = "paper_id string, order long, element_id string, text string, page int, section_path array<string>"
    for kind in ("recursive", "fixed"):
        parents = ck.split_parents(spark.createDataFrame(rows, schema), 20, splitter=kind).orderBy("parent_no").collect()
        assert [r.parent_no for r in parents] == list(range(1, len(parents) + 1))
        assert " ".join(" ".join(r.content.split()) for r in parents) == " ".join(r[3] for r in rows)
        assert {(r.page_start, r.page_end) for r in parents if r.group_no == 2} == {(1, 8)}
