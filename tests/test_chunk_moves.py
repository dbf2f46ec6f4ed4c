"""Texts are moved once where several lookups or sums need the same rows."""

import random

from docframe.operators import chunking as ck
from docframe.operators import cleaning as cl
from docframe.operators import ordered as od
from docframe.operators import packing


def exchanges_of(df, column):
    """Exchanges in the plan whose rows hold ``column``."""
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        names = node.output().mkString(" ").split()
        found += node.nodeName() == "Exchange" and any(x.split("#")[0] == column for x in names)
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


def plain_settings(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for k, v in zip(before, ("false", "-1")):
        spark.conf.set(k, v)
    return before


def test_run_sums_match_plain_python(spark):
    rng = random.Random(3)
    rows = [(k, o * 2, rng.choice([None, "a", "b"]) if o % 40 < 25 else "a", rng.randint(-2, 5)) for k in "xyz" for o in range(150)]
    df = spark.createDataFrame(rows, "k string, o long, v string, n long")
    got = {(r.k, r.o): (r.run, r.upto) for r in od.number_runs(df, ["k"], "o", "v", run="run", start="st", sums={"upto": "n"}, block_rows=7).collect()}
    want = {}
    for k in "xyz":
        run, total, last = 0, 0, object()
        for _, o, v, n in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            run, total = (run + 1, n) if v != last else (run, total + n)
            last = v
            want[k, o] = (run, total)
    assert got == want


ELEMENT = (
    "paper_id string, order bigint, self_ref string, parent_ref string, page int, tree_level int, element_type string, label string, "
    "level int, content_layer string, text string, bbox struct<l:double,t:double,r:double,b:double,coord_origin:string>, page_width double"
)


def test_audit_deals_the_texts_once(spark, tmp_path):
    rows = []
    for i in range(1, 1200):  # several blocks; the picture is far from most of its elements
        kind = "PictureItem" if i == 3 else "SectionHeaderItem" if i % 100 == 0 else "TextItem"
        rows.append(("p", i, f"#/{i}", "#/3" if i % 7 == 0 else "#/none" if i % 7 == 1 else None, 1, 1, kind, "text", 1, "body", f"t{i}", None, 612.0))
    rows.append(("q", 1, "#/1", "#/3", 1, 1, "TextItem", "text", 1, "body", "t", None, 612.0))  # another paper's picture
    spark.createDataFrame(rows, ELEMENT).write.parquet(str(tmp_path / "e"))
    before = plain_settings(spark)
    try:
        audit = cl.audit_elements(spark.read.parquet(str(tmp_path / "e")))
        assert exchanges_of(audit, "page_width") == 1
        got = {(r.paper_id, r.order): r for r in audit.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == len(rows)
    for r in rows:
        assert got[r[0], r[1]].inside_picture == (r[0] == "p" and r[3] == "#/3")
    assert got["p", 99].section_path == [] and got["p", 1150].section_path == ["t1100"]


def test_sections_move_their_texts_twice(spark, tmp_path):
    rows = [("p", i, f"word{i} and more", 1, [f"s{i // 9}"]) for i in range(200)]
    spark.createDataFrame(rows, "paper_id string, order long, text string, page int, section_path array<string>").write.parquet(str(tmp_path / "k"))
    kept = spark.read.parquet(str(tmp_path / "k"))
    runs = ck.section_runs(kept)
    before = plain_settings(spark)
    try:
        # A second exchange of the texts came with the running sum.
        assert exchanges_of(runs.select("paper_id", "group_no", "order", "text", "c"), "text") == 1
        got = {r.order: (r.group_no, r.n, r.c) for r in runs.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: (i // 9 + 1, 3, 3 * (i % 9)) for i in range(200)}


def test_windows_of_several_elements(spark):
    rows = [("p", 1, i, " ".join(f"w{i}.{j}" for j in range(4))) for i in range(6)]
    df = spark.createDataFrame(rows, "paper_id string, group_no long, order long, text string")
    got = [(r.no, r.content, [(x.first, x.last) for x in r.ranges]) for r in packing.cut_windows(df, 10, 2).orderBy("no").collect()]
    words = [f"w{i}.{j}" for i in range(6) for j in range(4)]
    assert got == [(n, " ".join(words[a:a + 10]), [(a // 4, min(a + 9, 23) // 4)]) for n, a in enumerate((0, 8, 16))]


def test_blocks_of_packed_groups_deal_their_texts_once(spark, tmp_path):
    rows = [("p", g, i, f"a{i} b c", 3, 3, 3 * i) for g in (1, 2) for i in range(30 if g == 1 else 3)]
    spark.createDataFrame(rows, "paper_id string, group_no long, order long, text string, n long, w long, c long").write.parquet(str(tmp_path / "g"))
    before = plain_settings(spark)
    try:
        blocks = packing._block_rows(spark.read.parquet(str(tmp_path / "g")), 10, 2)
        # The aggregate's rows were stored and dealt again to meet what belongs to their block.
        assert exchanges_of(blocks, "own") == 0 and exchanges_of(blocks, "buf") <= 2
        got = {(r.group_no, r.block): (len(r.own), r.many) for r in blocks.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {(1, 0): (7, True), (1, 1): (7, True), (1, 2): (6, True), (1, 3): (7, True), (1, 4): (3, True), (2, 0): (3, False)}


def test_linking_chunks_moves_no_text(spark):
    schema = "paper_id string, order bigint, page int, section_path array<string>, text string"
    rows = [(p, i, 1, [f"s{i // 9}"], " ".join(f"{p}{i}w{j}" for j in range(i % 23))) for p in "ab" for i in range(60)]
    rows += [("c", 1, 1, None, "x")]
    visuals = spark.createDataFrame(
        [("a", "figure", "figure_001", 1, "cap", None, [], [], 0), ("z", "table", "table_001", 2, None, "1 2", [], ["near"], 1)],
        "paper_id string, type string, element_id string, page int, caption string, docling_text string, section_path array<string>, surrounding_text array<string>, internal_texts long")
    for splitter in ("fixed", "recursive"):
        config = ck.ChunkingConfig(parent_max_tokens=40, child_max_tokens=12, overlap_tokens=3, splitter=splitter)
        chunks = ck.chunk(spark.createDataFrame(rows, schema), visuals, config)
        linked, looked_up = ck.link_parents(chunks), ck.link_parents(chunks.drop("parent_chunk_id"))
        assert linked.columns == looked_up.columns
        wanted = sorted((r.chunk_id, r.parent_chunk_id or "") for r in looked_up.collect())
        assert sorted((r.chunk_id, r.parent_chunk_id or "") for r in linked.collect()) == wanted
        assert len({p for _, p in wanted}) > 5
    before = plain_settings(spark)
    try:
        stored = spark.createDataFrame(chunks.collect(), chunks.schema)
        assert exchanges_of(ck.link_parents(stored), "content") == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
