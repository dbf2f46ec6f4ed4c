"""Operators on small hand-made rows and against plain Python."""

import datetime as dt
import random

from pyspark.sql import functions as F

from docframe.operators import chunking as ck
from docframe.operators import cleaning as cl
from docframe.operators import guardrails as gr
from docframe.operators import library as lb
from docframe.operators import ordered as od
from docframe.operators import qa
from docframe.operators import quotas as qt
from docframe.operators import records as rc
from docframe.operators import retrieval as rt
from docframe.operators import visuals as vs
from docframe.sources import readers, writers
from docframe.streaming import jobs

BOX = "struct<l:double,t:double,r:double,b:double,coord_origin:string>"
ELEMENT = (
    "paper_id string, order bigint, self_ref string, parent_ref string, page int, tree_level int, element_type string, "
    f"label string, level int, content_layer string, text string, bbox {BOX}, page_width double, caption_text string, captions array<string>"
)


def element(paper, order, text, label="text", kind="TextItem", level=None, page=1, parent=None, bbox=None):
    return (paper, order, f"#/{order}", parent, page, 1, kind, label, level, "body", text, bbox, 612.0, None, None)


def reason(spark, **kw):
    row = element("p", 1, kw.pop("text"), **kw)
    df = spark.createDataFrame([row], ELEMENT).selectExpr("*", "false AS inside_picture")
    return cl.classify_keep(df).first()["exclusion_reason"]


def test_keep_rules(spark):
    assert reason(spark, text="ICML 2024", label="page_header") == "label:page_header"
    assert reason(spark, text="") == "empty_text"
    assert reason(spark, text="12", bbox=(6.2, 0.0, 10.0, 1.0, "TL")) == "margin_line_number"
    assert reason(spark, text="128", bbox=(120.0, 0.0, 140.0, 1.0, "TL")) is None
    assert reason(spark, text="x", kind="TableItem") == "visual_element"


def test_scan_and_runs_match_plain_python(spark):
    rng = random.Random(7)
    rows = [(k, o * 3, rng.choice([None, "a", "b"]), rng.randint(0, 4)) for k in "xy" for o in range(60)]
    df = spark.createDataFrame(rows, "k string, o bigint, v string, n int")
    got = od.scan(df, ["k"], "o", sums={"s": "n"}, lasts={"l": "v"}, before={"b": "v"}, block_rows=7)
    runs = od.number_runs(df, ["k"], "o", "v", run="r", start="st", block_rows=7)
    want, want_runs = {}, {}
    for k in "xy":
        total, last, r, start, prev = 0, None, 0, None, object()
        for _, o, v, n in [x for x in rows if x[0] == k]:
            total += n
            before, last = last, v if v is not None else last
            if v != prev:
                r, start, prev = r + 1, o, v
            want[k, o], want_runs[k, o] = (total, last, before), (r, start)
    assert {(x.k, x.o): (x.s, x.l, x.b) for x in got.collect()} == want
    assert {(x.k, x.o): (x.r, x.st) for x in runs.collect()} == want_runs


def test_section_path_matches_a_stack(spark, monkeypatch):
    monkeypatch.setattr(cl, "LEAF_ROWS", 4)
    monkeypatch.setattr(cl, "FAN_IN", 3)
    rng = random.Random(3)
    rows, want = [], {}
    for paper in ("p", "q"):
        stack, last = [], None
        for o in range(1, 90):
            head = rng.random() < 0.4
            level = rng.randint(1, 4) if head else None
            rows.append(element(paper, o, f"h{o}", "section_header" if head else "text", level=level))
            if head:
                while stack and stack[-1][0] >= level:
                    stack.pop()
                stack.append((level, f"h{o}"))
                last = o
            want[paper, o] = ([h for _, h in stack] if last else [], last)
    got = cl.section_path(spark.createDataFrame(rows, ELEMENT)).collect()
    assert {(r.paper_id, r.order): (r.section_path, r.header_order) for r in got} == want


def test_parts_of_long_papers_concatenate(spark):
    rows = [element("p", o, f"text {o}", "section_header" if o == 3 else "text", level=1 if o == 3 else None) for o in range(1, 12)]
    df = spark.createDataFrame(rows, ELEMENT)
    kept, titles = cl.kept_elements(cl.audit_elements(df)), cl.infer_title(df)
    whole = cl.render_markdown(kept, titles).collect()
    parts = sorted((r.part, r.markdown) for r in cl.render_markdown(kept, titles, part_rows=4).collect())
    assert len(whole) == 1 and len(parts) == 3
    assert "".join(m for _, m in parts) == whole[0].markdown
    parts = ck.group_by_section(kept, part_tokens=6).filter("group_no = 2").orderBy("part").collect()
    joined = ck.group_by_section(kept).filter("group_no = 2").first()
    assert len(parts) == 3 and "\n\n".join(s.text for s in parts) == joined.text


def test_splitter_by_characters(spark):
    rng = random.Random(6)
    solid = "".join(chr(0x4E00 + i) for i in range(900))
    for text in (solid, solid[:50] + " " + solid[50:400] + "\n\n" + solid[400:], "ab\tcd " * 70, "x" * 7):
        for limit, overlap in ((7, 0), (40, 9)):
            chunks = ck.split_text(text, limit, overlap, length=len)
            assert all(len(c) <= limit for c in chunks)
            assert set("".join(chunks).split()) and set("".join(text.split())) == set("".join("".join(chunks).split()))
    assert ck.split_text(solid, 40, 9, length=len)[1][:9] == solid[31:40]
    words = " ".join(rng.choice("abc") * rng.randrange(1, 9) for _ in range(200))
    assert " ".join(ck.split_text(words, 30, 0, length=len)) == words
    elements = spark.createDataFrame([("p", 1, "e", solid, 1, ["s"])], "paper_id string, order long, element_id string, text string, page int, section_path array<string>")
    parents = ck.split_parents(elements, 100, length=len)
    assert "".join(r.content for r in parents.orderBy("parent_no").collect()) == solid
    assert parents.count() == 9


def test_splitter_contract():
    rng = random.Random(5)
    for limit, overlap in ((20, 0), (30, 7)):
        words = [f"w{i}" + rng.choice(["", "", ".", ".\n", "\n\n"]) for i in range(700)]
        text = " ".join(words)
        chunks = ck.split_text(text, limit, overlap)
        assert all(len(c.split()) <= limit for c in chunks)
        position = {w: i for i, w in enumerate(text.split())}
        covered = {position[w] for c in chunks for w in c.split()}
        assert covered == set(range(700))
        starts = [position[c.split()[0]] for c in chunks]
        assert starts == sorted(starts)
        shared = [len(set(a.split()) & set(b.split())) for a, b in zip(chunks, chunks[1:])]
        assert max(shared) <= overlap and (overlap == 0 or max(shared) > 0)


def test_section_boundaries_and_visual_chunks(spark):
    rows = [element("p", 1, "Intro", "section_header", level=1), element("p", 2, "word " * 1200), element("p", 3, "Methods", "section_header", level=1, page=2),
            element("p", 4, "term " * 1200, page=2), element("p", 5, "E = mc", "formula", "FormulaItem", page=2), element("p", 6, "", "table", "TableItem", page=2),
            element("p", 7, "", "picture", "PictureItem", page=2), element("p", 8, "axis label", parent="#/7", page=2)]
    df = spark.createDataFrame(rows, ELEMENT)
    kept = cl.kept_elements(cl.audit_elements(df))
    chunks = ck.chunk(kept, vs.describe_visuals(df), ck.ChunkingConfig(400, 120, 20)).collect()
    parents = [c for c in chunks if c.chunk_type == ck.PARENT]
    assert len(parents) >= 6 and all(("word" in p.content) != ("term" in p.content) for p in parents if len(p.content) > 20)
    assert sorted(c.chunk_type for c in chunks if c.parent_no is None) == ["equation", "figure", "table"]
    assert [c.has_internal_text for c in chunks if c.chunk_type == "figure"] == [True]


def test_mixed_quota_requests_match_a_loop(spark):
    rng = random.Random(11)
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(600):
        hot = rng.random() < 0.5
        rows.append((i, "hot" if hot else f"s{rng.randint(0, 9)}", t0 + dt.timedelta(minutes=rng.randint(0, 6000)),
                     rng.randint(0, 4), rng.choice([0, 0, 1, 3]), rng.choice([0, 0, 1])))
    r = spark.createDataFrame(rows, "request_id bigint, session_id string, ts timestamp, queries int, papers int, images int")
    s = qt.open_sessions(r)
    got = {x.request_id: (x.admitted, x.rejected_for) for x in qt.admit(r, s).collect()}
    left, ends, want = {}, {}, {}
    for i, sid, ts, *amounts in sorted(rows, key=lambda x: (x[2], x[0])):
        ends.setdefault(sid, ts + dt.timedelta(hours=72))
        room = left.setdefault(sid, [10, 2, 2])
        short = [k for k, a, m in zip(qt.KINDS, amounts, room) if a and m < a]
        if ts >= ends[sid]:
            want[i] = (False, "expired")
        elif short:
            want[i] = (False, short[0])
        else:
            left[sid] = [m - a for m, a in zip(room, amounts)]
            want[i] = (True, None)
    assert got == want


def test_quota_stream_carries_sessions_over_batches(spark, tmp_path):
    rng = random.Random(12)
    t0, schema = dt.datetime(2024, 1, 1), "request_id bigint, session_id string, ts timestamp, queries int, papers int, images int"
    rows = [
        (i, "hot" if rng.random() < 0.5 else f"s{rng.randint(0, 5)}", t0 + dt.timedelta(minutes=25 * i), rng.randint(0, 3), rng.choice([0, 0, 1]), rng.choice([0, 1]))
        for i in range(240)
    ]
    batches = [rows[:70], rows[70:150], rows[150:]]
    for n, batch in enumerate(batches):  # files are read in the order of their times
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    jobs.run_once(jobs.admit_batches(feed, f"{tmp_path}/state", f"{tmp_path}/out", f"{tmp_path}/log"))
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {(x.v, x.request_id) for x in got} == {(n, r[0]) for n, batch in enumerate(batches) for r in batch}
    every = spark.createDataFrame(rows, schema)
    want = qt.admit(every, qt.open_sessions(every)).collect()
    assert {x.request_id: (x.admitted, x.rejected_for) for x in got} == {x.request_id: (x.admitted, x.rejected_for) for x in want}
    assert {"expired", None} < {x.rejected_for for x in got}


def test_bm25_pads_and_dense_tiles_agree_with_one_tile(spark):
    docs = [(f"c{i:02d}", f"alpha beta w{i}" if i % 3 else f"gamma w{i}") for i in range(30)]
    corpus = spark.createDataFrame(docs, "chunk_id string, content string")
    q = spark.createDataFrame([(1, "gamma w3"), (2, "  ")], "query_id int, query string")
    plain = rt.bm25(corpus, q, 12).collect()
    assert len(plain) == 10 and plain[0].query_id == 1
    padded = rt.bm25(corpus, q, 12, pad_unmatched=True).collect()
    assert sorted((r.query_id, r.rank) for r in padded) == [(i, k) for i in (1, 2) for k in range(1, 13)]
    rng = random.Random(1)
    vec = lambda: [rng.gauss(0, 1) for _ in range(8)]
    c = spark.createDataFrame([(i, vec()) for i in range(50)], "chunk_id bigint, embedding array<double>")
    p = spark.createDataFrame([(i, vec()) for i in range(9)], "query_id bigint, embedding array<double>")
    one = sorted(map(tuple, rt.dense_topk(c, p, 5).collect()))
    assert one == sorted(map(tuple, rt.dense_topk(c, p, 5, tile=7).collect())) and len(one) == 45


def test_fusion_ignores_input_order_and_labels(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, chunk_id string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "query_id int, chunk_id string, rank int")
    one = sorted(map(tuple, rt.fuse({"sparse": a, "dense": b}).collect()))
    assert one == sorted(map(tuple, rt.fuse({"dense": b, "sparse": a}).collect())) and len(one) == 3
    rows = [("abcdefghij", "text", [], None, None), ("b", "text", ["S", "T"], 0, None), ("c", "table", [], None, 0), ("d", "text", ["S"], None, 4), ("e", "equation", [], 2, 2)]
    df = spark.createDataFrame(rows, "chunk_id string, chunk_type string, section_path array<string>, page_start int, page_end int")
    assert [r[0] for r in df.selectExpr(rt.citation_label()).collect()] == ["[Chunk abcdefgh]", "[Section S > T]", "[Table]", "[Page 4, Section S]", "[Equation, Page 2]"]


def test_answer_refuses_without_evidence(spark):
    corpus = spark.createDataFrame(
        [("c1", "p1", "Calibration improves accuracy. Noise is small.", "text", ["Results"], 2, 2, None)],
        "chunk_id string, paper_id string, content string, chunk_type string, section_path array<string>, page_start int, page_end int, parent_chunk_id string")
    q = spark.createDataFrame([("a", "p1", "does calibration improve accuracy"), ("b", "p1", "zebra"), ("c", "p9", "calibration")], "query_id string, paper_id string, query string")
    got = {r.query_id: r for r in qa.answer(corpus, q).collect()}
    assert got["a"].answer == "Calibration improves accuracy. [Page 2, Section Results]" and got["a"].pages == [2]
    assert got["b"].confidence == got["c"].confidence == "insufficient"
    assert got["c"].limitations == [qa.NO_CHUNKS] and got["c"].used_chunks == []


def test_citation_check_keeps_the_last_chunk_of_a_label(spark):
    rows = [("q", 1, "c1", "[Page 1]", "text", None), ("q", 2, "c2", "[Page 1]", "text", None), ("q", 3, "c3", "[Table, Page 1]", "table", "table_001")]
    names = "query_id string, rank int, chunk_id string, citation string, chunk_type string, element_id string"
    e = spark.createDataFrame(rows, names).selectExpr("*", "1 AS page_start", "1 AS page_end", "'p' AS paper_id", "'text' AS content", "array('s') AS section_path", "1D AS score")
    s = spark.createDataFrame([("q", " Yes. ", "high", ["[Page 7]", "[Page 1]"]), ("r", "No.", "low", ["[Page 7]"]), ("t", "?", "insufficient", [])],
                              "query_id string, answer string, confidence string, used_citation_labels array<string>")
    got = {r.query_id: r for r in qa.validate_citations(s, e).collect()}
    assert (got["q"].answer, got["q"].used_chunks, got["q"].rejected) == ("Yes. [Page 1]", ["c2"], False)
    assert [c.label for c in got["q"].citations] == ["[Page 1]"] and [x.chunk_id for x in got["q"].evidence] == ["c2"] and got["q"].used_visual_elements == []
    assert got["r"].rejected and not got["t"].rejected
    both = spark.createDataFrame([("q", "A", "low", ["[Table, Page 1]"])], s.schema)
    assert qa.validate_citations(both, e).first().used_visual_elements == ["table_001"]


def test_failures_of_another_owner_are_kept_apart(spark):
    fields = "status string, parse_status string, error string, warnings string, page_count int"
    papers = spark.createDataFrame([("a", "u", "f.pdf", "ready", "ok", None, None, 3), ("b", "u", "g.pdf", "ready", "ok", None, None, 3)], f"paper_id string, user_id string, filename string, {fields}")
    jobs = spark.createDataFrame([], "job_id string, paper_id string, status string, progress double, error string, created_at timestamp")
    rows = [("a", "v", "x.pdf", "failed", "failed", "bad", None, 0, None), ("b", "u", "y.pdf", "failed", "failed", "bad", None, 0, None), ("z", "w", "z.pdf", "failed", "failed", "bad", None, 0, None)]
    failures = spark.createDataFrame(rows, f"paper_id string, user_id string, filename string, {fields}, job_id string")
    out, _ = lb.record_failures(papers, jobs, failures)
    assert {(r.paper_id, r.user_id, r.filename, r.status) for r in out.collect()} == {("a", "u", "f.pdf", "ready"), ("b", "u", "y.pdf", "failed"), ("z", "w", "z.pdf", "failed")}
    assert [r.paper_id for r in lb.failure_conflicts(papers, failures).collect()] == ["a"]


def test_library_match_with_a_hot_title(spark):
    papers = spark.createDataFrame([(f"p{i}", "u", "Untitled", "10.1/x" if i == 0 else None, None) for i in range(200)], "paper_id string, user_id string, title string, doi string, arxiv_id string")
    records = spark.createDataFrame([(i, "u", " untitled ", "10.1/X" if i % 2 else None, None) for i in range(300)] + [(999, "v", "Untitled", None, None)],
                                    "record_id bigint, user_id string, title string, doi string, arxiv_id string")
    got = {r.record_id: (r.matches, r.first_match) for r in rc.match_library(records, papers).collect()}
    assert len(got) == 301 and got[0] == got[1] == (200, "p0") and got[999] == (0, None)
    assert rc.dedupe_records(records, "record_id").count() == 2


def test_replace_and_upsert(spark):
    t = spark.createDataFrame([("a", "u", "f1", None), ("b", "v", "f2", "kept")], "paper_id string, user_id string, filename string, title string")
    n = spark.createDataFrame([("a", "u", "g1", "new"), ("b", "w", "g2", "new"), ("c", "w", "g3", "new")], t.schema)
    merged, conflicts = lb.upsert(t, n, "paper_id", fill_only=["title"])
    assert sorted(map(tuple, merged.collect())) == [("a", "u", "g1", "new"), ("b", "v", "f2", "kept"), ("c", "w", "g3", "new")]
    assert [r.paper_id for r in conflicts.collect()] == ["b"]
    named = t.withColumnRenamed("filename", "foreign_ref")
    merged, _ = lb.upsert(named, n.withColumnRenamed("filename", "foreign_ref"), "paper_id", fill_only=["title"])
    assert {r.foreign_ref for r in merged.collect()} == {"g1", "f2", "g3"}
    once = lb.replace_documents(t, n)
    assert sorted(map(tuple, lb.replace_documents(once, n).collect())) == sorted(map(tuple, once.collect()))


def test_bucketed_overwrite_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda names, v: spark.createDataFrame([(n, v) for n in names], "paper_id string, v int")
    writers.overwrite_documents(rows("abcdef", 1), path, buckets=2)
    for _ in range(2):
        writers.overwrite_documents(rows("ax", 2), path, buckets=2)
    got = {(r.paper_id, r.v) for r in spark.read.parquet(path).collect()}
    assert got == {("a", 2), ("x", 2)} | {(n, 1) for n in "bcdef"} and spark.read.parquet(path).count() == 7
    # Renewed documents without rows leave nothing behind, also where their bucket becomes empty.
    writers.overwrite_documents(rows("a", 3), path, buckets=2, renewed=rows("abcd", 0))
    assert {tuple(r) for r in spark.read.parquet(path).select("paper_id", "v").collect()} == {("a", 3), ("x", 2), ("e", 1), ("f", 1)}
    writers.overwrite_documents(rows("", 4), path, buckets=2, renewed=rows("aef", 0))
    assert [r.paper_id for r in spark.read.parquet(path).collect()] == ["x"]


def test_file_intake_and_inventory(spark, tmp_path):
    for name, data in {"a b.pdf": b"%PDF-1", "x.txt": b"%PDF", "empty.pdf": b"", "bad.pdf": b"<html>", "big.pdf": b"%PDF" + b"0" * 100}.items():
        (tmp_path / name).write_bytes(data)
    ok, no = readers.intake_files(spark, str(tmp_path), max_bytes=50)
    assert [(r.filename, r.length) for r in ok.collect()] == [("a_b.pdf", 6)]
    assert {r.filename.replace("%20", " "): r.reason for r in no.collect()} == {"x.txt": "not_pdf_extension", "bad.pdf": "not_pdf_content", "big.pdf": "too_large", "empty.pdf": "empty"}
    # Spark's file scans leave out empty files; a listing handed in as a table can name them.
    listing = spark.createDataFrame([("e.pdf", 0, None), (None, 5, "%PDF"), ("ok.PDF", 5, "%PDF")], "name string, size bigint, head string")
    assert [r[0] for r in listing.selectExpr(readers.intake_reason("name", "size", "head")).collect()] == ["empty", "no_filename", None]
    (tmp_path / "raw" / "papers" / "p1").mkdir(parents=True)
    (tmp_path / "raw" / "papers" / "p1" / "f.bin").write_bytes(b"123")
    assert [tuple(r) for r in readers.artifact_inventory(spark, str(tmp_path)).select("paper_id", "kind", "objects", "bytes").collect()] == [("p1", "raw", 1, 3)]
    assert readers.read_jsonl(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0


def test_message_checks(spark):
    long, png = "x" * 8001, "data:image/png;base64,aGVsbG8="
    rows = [(1, " ", [], None), (2, long, [], None), (3, "hi", [str(i) for i in range(9)], None), (4, "hi", [], png), (5, "", [], png), (6, "hi", [], "data:image/png;base64,!"), (7, "hi", [], "data:image/png;base64,")]
    df = spark.createDataFrame(rows, "id int, message string, selected_papers array<string>, image_data_url string")
    got = {r.id: r.code for r in gr.validate_messages(df).collect()}
    assert got == {1: "empty_message", 2: "message_too_long", 3: "too_many_papers", 4: None, 5: None, 6: "invalid_image_mime", 7: "invalid_image_mime"}


def test_parse_reports(spark):
    rows = [("SUCCESS", [], 5, 5, True, 5), ("SUCCESS", ["std::bad_alloc"], 5, 5, True, 5), ("PARTIAL_SUCCESS", [], 5, 5, True, 5), ("SUCCESS", [], 3, 5, True, 5), ("SUCCESS", [], 0, 0, True, None), ("SUCCESS", [], 0, 0, False, None)]
    df = spark.createDataFrame(rows, "status string, errors array<string>, processed_pages int, document_pages int, has_document boolean, expected_pages int")
    assert [r.accepted for r in cl.validate_parse(df).collect()] == [True, False, False, False, False, False]


def test_fallback_only_for_failures(spark):
    hits = lambda *r: spark.createDataFrame(list(r), "query_id string, title string")
    out = rc.with_fallback(hits(("b", "")), hits(("a", "one")), hits(("b", "two"), ("c", "three")))
    assert sorted(map(tuple, out.collect()), key=str) == [("a", "one", None), ("b", "two", "primary_source_failed")]


def test_failure_of_an_unknown_paper_is_added(spark):
    fields = "status string, parse_status string, error string, warnings string, page_count int"
    papers = spark.createDataFrame([("a", "u", "ready", "ok", None, None, 3)], f"paper_id string, user_id string, {fields}")
    jobs = spark.createDataFrame([], "job_id string, paper_id string, status string, progress double, error string, created_at timestamp")
    failures = spark.createDataFrame([("z", "failed", "failed", "bad file", None, 0, None)], f"paper_id string, {fields}, job_id string")
    out, _ = lb.record_failures(papers, jobs, failures)
    assert {(r.paper_id, r.user_id, r.status, r.error) for r in out.collect()} == {("a", "u", "ready", None), ("z", None, "failed", "bad file")}


def test_enrichment_lists_follow_the_json_type(spark):
    cases = {
        '"[see note]"': ["[see note]"], '"null"': ["null"], "null": [], "[]": [], "7": ["7"],
        '["{x} is best", null, {"b": 1, "a": null}]': ["{x} is best", "None", "b: 1; a: None"], '{"k": "v"}': ["k: v"],
    }
    rows = spark.createDataFrame([(k, f'{{"columns": {k}}}') for k in cases], "name string, payload string")
    got = rows.select("name", vs.coerce_enrichment("table", F.col("payload"))["columns"].alias("v")).collect()
    assert {r.name: r.v for r in got} == cases


def test_papers_without_text_have_their_outputs(spark):
    titles = spark.createDataFrame([("p", "T"), ("q", None), ("r", "")], "paper_id string, title string")
    kept = spark.createDataFrame([("p", 1, "body", ["T"])], "paper_id string, order long, text string, section_path array<string>")
    got = {r.paper_id: (r.part, r.markdown) for r in cl.render_markdown(kept, titles).collect()}
    assert got == {"p": (0, "# T\n\n## T\n\nbody\n"), "q": (0, "\n"), "r": (0, "\n")}


def test_one_parent_with_most_elements_is_spread(spark):
    rows = [("p", 0, "#/pic", "#/body", "PictureItem")] + [("p", i, f"#/{i}", "#/pic" if i % 10 else "#/body", "TextItem") for i in range(1, 3000)]
    df = spark.createDataFrame(rows, "paper_id string, order long, self_ref string, parent_ref string, element_type string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    for k, v in zip(before, ("false", "-1", "16")):
        spark.conf.set(k, v)
    try:
        flagged = cl.flag_inside_picture(df)
        assert flagged.filter("inside_picture").count() == sum(1 for r in rows if r[3] == "#/pic")
        sizes = flagged.groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) > 8 and max(r["count"] for r in sizes) < 0.4 * len(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_hybrid_results_are_the_lists_fused_in_python(spark):
    rng = random.Random(11)
    vec = lambda: [rng.gauss(0, 1) for _ in range(6)]
    rows = [(f"c{i:02d}", "p", " ".join(rng.choices("alpha beta gamma delta eps".split(), k=rng.randrange(1, 9))), "text", ["S"], 1, 1, None, vec()) for i in range(60)]
    corpus = spark.createDataFrame(rows, "chunk_id string, paper_id string, content string, chunk_type string, section_path array<string>, page_start int, page_end int, "
                                   "parent_chunk_id string, embedding array<double>")
    queries = spark.createDataFrame([(1, "alpha delta"), (2, "eps"), (3, " ")], "query_id int, query string")
    vectors = spark.createDataFrame([(q, vec()) for q in (1, 2, 3)], "query_id int, embedding array<double>")
    sparse = rt.bm25(corpus, queries, 12).collect()
    dense = rt.dense_topk(corpus, vectors.where("query_id < 3"), 12).collect()
    want = {}
    for q in (1, 2):
        score = {}
        for rows_of, weight in ((sparse, 0.45), (dense, 0.55)):
            for r in rows_of:
                if r.query_id == q:
                    score[r.chunk_id] = score.get(r.chunk_id, 0) + weight / (60 + r.rank)
        want[q] = [c for c, _ in sorted(score.items(), key=lambda x: (-round(x[1], 12), x[0]))[:5]]
    got = rt.retrieve(corpus, queries, top_k=5, candidate_pool=12, vectors=vectors, with_parents=False).collect()
    assert {q: [r.chunk_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in (1, 2)} == want and len(got) == 10
