"""File listing, intake and XML feeds from real files."""

import pytest

from docframe.operators import records as rc
from docframe.operators.cleaning import AUDIT_COLUMNS
from docframe.session import scratch_path
from docframe.sources import listing, readers, writers


def test_listing_and_intake(spark, tmp_path):
    files = {
        "a/x y.pdf": b"%PDF-1", "a/empty.pdf": b"", "b/c/deep.PDF": b"%PDF" + b"z" * 30, "large.pdf": b"%PDF" + b"z" * 200,
        "b/page.html": b"<p>", "b/fake.pdf": b"nope", "a/.pdf": b"%PDF",
    }
    for name, content in files.items():
        target = tmp_path / "in" / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(content)
    root = f"{tmp_path}/in"
    found = {r.path[len(root) + 1 :]: (r.length, r.content) for r in listing.list_files(spark, root, 50).collect()}
    assert found == {k: (len(v), bytearray(v) if 0 < len(v) <= 50 else None) for k, v in files.items()}
    accepted, rejected = readers.intake_files(spark, f"file://{root}", 50)
    assert {(r.filename, r.length, bytes(r.content)) for r in accepted.collect()} == {
        ("x_y.pdf", 6, b"%PDF-1"), ("deep.PDF", 34, b"%PDF" + b"z" * 30)
    }
    # ".pdf" is stored as "pdf", which has no extension
    assert {(r.filename, r.reason) for r in rejected.collect()} == {
        ("empty.pdf", "empty"), ("large.pdf", "too_large"), ("page.html", "not_pdf_extension"), ("fake.pdf", "not_pdf_content"), (".pdf", "not_pdf_extension")
    }


def test_empty_folder(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert listing.list_files(spark, f"{tmp_path}/none").collect() == []


def test_written_files(spark):
    path = scratch_path(spark, "files")
    rows = [("a/1.bin", bytearray(b"one")), ("2.bin", None)]
    listing.write_files(spark.createDataFrame(rows, "name string, content binary"), path)
    assert sorted((r.filename, r.length) for r in listing.list_files(spark, path).collect()) == [("1.bin", 3), ("2.bin", 0)]


def test_folder_per_paper(spark, tmp_path):
    papers = [None, "", "1", "a/b=c%*", "Ü"]
    text = ["x", None, "", 'q"u,o']
    rows = [(p, i, t) for p in papers for i, t in enumerate(text)]
    elements = spark.createDataFrame(rows, "paper_id string, order long, text string").selectExpr(
        "*", "concat('e', order) AS element_id", "1 AS page", "array('A') AS section_path", "'t' AS type", "'l' AS label",
        "named_struct('l', 1D) AS bounding_box", "'o' AS coordinate_origin", "'s' AS source_ref")
    root = f"{tmp_path}/out"
    writers.write_cleaned_jsonl(elements, root)
    found = {f.relative_to(root).as_posix().rsplit("/", 1)[0] for f in (tmp_path / "out").rglob("*.json")}
    assert found == {f"paper_id={n}" for n in ("__HIVE_DEFAULT_PARTITION__", "1", "a%2Fb%3Dc%25%2A", "Ü")}
    # No file beside those, as a commit by Spark would leave.
    assert {f.suffix for f in (tmp_path / "out").rglob("*") if f.is_file() and f.name != "_SUCCESS"} == {".json"}
    back = readers.read_jsonl(spark, root, "paper_id string, element_id string, text string")
    assert sorted(((r.paper_id, r.element_id, r.text) for r in back.collect()), key=repr) == sorted(((p or None, f"e{i}", t) for p, i, t in rows), key=repr)
    with pytest.raises(FileExistsError):
        writers.write_cleaned_jsonl(elements, root)


def test_noted_files_are_read_without_a_listing(spark, tmp_path):
    papers = [None, "", "1", "a/b=c%*", "Ü", *(f"p{i}" for i in range(40))]
    text = ["x", None, "", 'q"u,o', "a\\b, 'c' ", "line\u2028sep", " ", "# x"]
    rows = [(p, i, t) for p in papers for i, t in enumerate(text)]
    audit = spark.createDataFrame(rows, "paper_id string, order long, text string").selectExpr(
        "*", "concat('e', order) AS element_id", "'s' AS self_ref", "'b' AS parent_ref", "1 AS page", "1 AS tree_level", "'t' AS element_type", "'l' AS label",
        "'body' AS content_layer", "array('A', 'B') AS section_path", "3 AS text_length", "named_struct('l', 1D) AS bounding_box", "'o' AS coordinate_origin",
        "false AS inside_picture", "true AS keep_for_text", "CAST(NULL AS STRING) AS exclusion_reason")
    writers.write_audit_csv(audit, f"{tmp_path}/csv")
    schema = ", ".join(f"`{c}` {'bigint' if c == 'order' else 'string'}" for c in AUDIT_COLUMNS) + ", paper_id string"
    listed = spark.read.schema(schema).csv(f"{tmp_path}/csv", header=True, quote='"', escape='"')
    noted = readers.read_audit_csv(spark, f"{tmp_path}/csv", schema)
    order = lambda df: sorted(map(tuple, df.select(listed.columns).collect()), key=repr)
    assert order(noted) == order(listed) and noted.count() == len(rows)

    kept = audit.selectExpr("*", "element_type AS type", "self_ref AS source_ref")
    writers.write_cleaned_jsonl(kept, f"{tmp_path}/json")
    fields = "paper_id string, element_id string, section array<string>, bounding_box struct<l:double>, text string"
    listed, noted = readers.read_jsonl(spark, f"{tmp_path}/json", fields), readers.read_jsonl(spark, f"{tmp_path}/json", fields, folders="paper_id")
    assert noted.schema.simpleString() == listed.schema.simpleString()
    assert order(noted) == order(listed) and noted.count() == len(rows)
    # What the driver knows is the table of files, not a file per paper.
    assert len(listed.inputFiles()) >= len(papers) - 1 and all("json.files" in f for f in noted.inputFiles()) and len(noted.inputFiles()) <= 8


def test_many_folders_are_listed_in_few_tasks(spark, tmp_path):
    for i in range(100):
        (tmp_path / f"paper_id={i}").mkdir()
        (tmp_path / f"paper_id={i}/part.json").write_text('{"text": "x"}\n')
    spark.sparkContext.setJobGroup("listing", "")
    rows = readers.read_jsonl(spark, str(tmp_path), "paper_id string, text string")
    tracker = spark.sparkContext.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert stages and max(tracker.getStageInfo(s).numTasks for s in stages) <= 64
    assert rows.distinct().count() == 100


def test_malformed_entries_are_kept_apart(spark, tmp_path):
    good = '<entry><id>http://x/abs/1v1</id><title> A\nB </title><published>2020-01-02</published><author><name>N</name></author><author><name> </name></author>' \
        '<link href="u" type="text/html"/><link href="p" title="pdf"/></entry>'
    bad = "<entry><id>2</id><title>broken</entry>"
    (tmp_path / "f.xml").write_text(f'<feed xmlns="http://www.w3.org/2005/Atom">{good}\n{bad}\n{good.replace("1v1", "3v2")}</feed>')
    entries, malformed = readers.read_arxiv_xml(spark, f"{tmp_path}/f.xml", rc.ARXIV_ENTRY)
    got = sorted((r.arxiv_id, r.title, r.authors, r.year, r.pdf_url) for r in rc.normalize_arxiv(entries).collect())
    assert got == [("1v1", "A B", ["N"], 2020, "p"), ("3v2", "A B", ["N"], 2020, "p")]
    assert [("broken" in r._malformed) for r in malformed.collect()] == [True]


def test_matches_without_pairs_of_titles(spark):
    schema = "record_id long, user_id string, doi string, arxiv_id string, title string"
    records = spark.createDataFrame([(1, "u", "D1", None, "T"), (2, "u", "D9", "A1", "T"), (3, "v", "D1", None, "T"), (4, "u", None, None, "other")], schema)
    shelf = [("p1", "u", "d1", None, "x"), ("p2", "u", "d1", None, " t "), ("p3", "u", None, "a1", "T"), ("p4", "u", None, None, "t"), ("p5", "v", None, None, "x")]
    papers = spark.createDataFrame(shelf, schema.replace("record_id long", "paper_id string"))
    keys = {(r.record_id, r.kind): (r.key, r.papers, r.fresh) for r in rc.match_keys(records, papers).collect()}
    assert keys == {(1, "doi"): ("d1", 2, 2), (1, "title"): ("t", 3, 2), (2, "arxiv"): ("a1", 1, 1), (2, "title"): ("t", 3, 2)}
    one = rc.first_matches(records, papers, 2)
    assert sorted((r.record_id, r.paper_id, r.place) for r in one.collect()) == [(1, "p1", 1), (1, "p2", 2), (2, "p2", 1), (2, "p3", 2)]
    two = rc.first_matches(records, papers, 2, one.where("place = 2").select("record_id", "paper_id"))
    assert sorted((r.record_id, r.paper_id, r.place) for r in two.collect()) == [(1, "p3", 1), (1, "p4", 2), (2, "p4", 1)]
