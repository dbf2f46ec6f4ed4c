"""The corpus pipeline against a plain version of its stages on a small planted corpus."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from docframe.llm import queries

VOCABULARY = {
    "en": "the of and was with from this that thing other house water under every people small".split(),
    "de": "der die das und nicht eine werden schön über auch haus wasser unter jeder leute klein".split(),
}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, word string"


def planted() -> tuple[list[tuple], list[tuple]]:
    """Rows (doc_id, text, lang) and benchmark items; every document below 100 is clean."""
    rng = random.Random(11)

    def prose(lang: str, n: int) -> str:
        return " ".join(rng.choice(VOCABULARY[lang]) for _ in range(n))

    rows = [(i, f"{prose(lang, 50)}\n{prose(lang, 70)}", lang) for i, lang in enumerate(["en", "de"] * 30)]
    line, passage = prose("en", 12), prose("de", 24)
    rows += [(100 + i, f"{prose('en', 60)}\n{line}\n{prose('en', 20)}", "en") for i in range(4)]
    rows += [(110, rows[6][1], "en"), (111, rows[6][1], "en"), (None, rows[7][1], None)]
    words = rows[8][1].split(" ")
    rows += [(120 + i, " ".join([*words[: 30 + i], "changed", *words[31 + i :]]), None) for i in range(3)]
    rows += [(130, f"{prose('de', 30)} {passage} {prose('de', 30)}", "de"), (131, f"{prose('de', 40)}\n{passage.title()}", "de")]
    rows += [(140, None, "en"), (141, "", "de"), (142, "123 !\n\n", None), (143, " \t\n ", "en")]
    rows += [(150, prose("en", 9000), "en"), (9, rows[9][1], "de"), (9, rows[9][1], "de")]
    items = [("q1", passage), ("q2", prose("de", 30)), ("q3", None), ("q4", ""), (None, prose("en", 20)), ("q1", passage)]
    return rows, items


def plain(rows: list[tuple], items: list[tuple]) -> list[tuple]:
    """Language by membership of words, then each stage by brute force."""
    clear = {(k, t) for k, t, _ in rows if t and any(w in t.split() for v in VOCABULARY.values() for w in v)}
    docs = sorted(clear, key=lambda r: (r[0] is None, r[0] or 0))
    lined = []
    for (key, text), (_, _, exact, near) in zip(docs, brute.lines(docs)):
        kept = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in {*exact, *near})
        lined.append((key, text if len(kept) < (1 - corpus_pipeline.MAX_LINE_SHARE) * len(text) else kept))
    shingles, single = [brute.shingles(t) for _, t in lined], []
    root = list(range(len(lined)))
    for i in range(len(lined)):
        for j in range(i):
            if brute.jaccard(shingles[i], shingles[j]) >= 0.8:
                root = [root[j] if r == root[i] else r for r in root]
    for r in set(root):
        group = [lined[i] for i in range(len(lined)) if root[i] == r]
        single.append(min(group, key=lambda x: (x[0] is None, x[0] or 0)))
    clean = {r[0] for r in brute.decontaminate(single, [i for i in items if i[0]]) if not r[5]}
    library, out = Tokenizer.from_str(queries.vocabulary()), []
    for key, text in single:
        if key in clean:
            ids = library.encode(text, add_special_tokens=False).ids
            digest = brute.hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            out.append((key, text, len(text), len(ids), digest, brute.sha(text)))
    return sorted(out, key=repr)


@pytest.fixture
def folder(spark, tmp_path):
    def write(rows, items):
        docs = [(k, t, lang, "kept", None if t is None else len(t), 1, "x") for k, t, lang in rows]
        spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
        return str(tmp_path)

    return write


def test_whole_pipeline(spark, folder):
    rows, items = planted()
    out = corpus_pipeline.run(spark, folder(rows, items))
    assert {"source", "n_words", "word"} <= set(out.columns)
    assert {r["source"] for r in out.collect()} == {"kept"}
    got = out.select("doc_id", "text", "n_chars", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows, items)
    assert set(range(60)) <= {r.doc_id for r in got}


def test_stages_keep_columns_of_documents(spark, folder):
    rows, items = planted()
    path = folder(rows, items)
    docs = queries.table(spark, path, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns


def test_pipeline_of_nothing(spark, folder):
    assert corpus_pipeline.run(spark, folder([], [])).count() == 0


def test_near_duplicates_of_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, "")], "doc_id long, text string")
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(map(tuple, out.select("doc_id", F.length("text")).collect()), key=repr) == [(1, 11), (2, None), (3, 0)]


def test_near_duplicates_of_repeated_ids(spark):
    """An id that stands for one class is no reason to keep its copy of another."""
    long = " ".join(map(str, range(30)))
    docs = spark.createDataFrame([(1, "a b c d e f"), (None, "only here"), (2, "a b c d e f"), (2, long), (None, long)], "doc_id long, text string")
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(1, "a b c d e f"), (2, long), (None, "only here")], key=repr)


def test_stages_leave_given_values_alone(spark, folder):
    """Columns named as an operator's own keep their values."""
    path = folder(*planted())
    own = ["score", "margin", "rejected", "lang_pred", "kept", "n_lines", "exact", "near", "n_words", "n_hit", "items", "_doc", "_found", "copies"]
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    given = docs.selectExpr("*", *[f"concat('{c}', doc_id) AS `{c}`" for c in own])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, given, path)
        assert out.columns == given.columns
        assert out.where(" OR ".join(f"NOT `{c}` <=> concat('{c}', doc_id)" for c in own)).count() == 0, name


def test_near_duplicates_keep_the_first_of_repeated_rows(spark):
    rows = [(1, "a b c d e f g", "z"), (1, "a b c d e f g", "b"), (2, "a b c d e f g", "a")]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), "")
    assert [tuple(r) for r in got.collect()] == [(1, "a b c d e f g", "b")]
