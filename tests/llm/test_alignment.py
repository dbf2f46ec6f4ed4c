"""Cross-tokenizer alignment against whole-text encoding and dictionaries of ends."""

import random

import brute
import numpy as np
import pytest

from docframe.llm import alignment, queries
from docframe.session import materialize

ODD = [
    None, "", " ", "  a", "a  b", "a\n b", "\ta b ", "x▁y", "<|endoftext|> <s> </s> <unk> <0x41>", "日本語 テキスト です", "a\xa0b", " lead",
    "trail ", "it's we're 'S", "a" * 5000, " ".join(["ab"] * 3000), "é é ﬁ", "\x00 a\x1c b", "🙂 🙂🙂 a", "　a b", "a\x85 b", "​a ​b",
    "1 23 456 7890,12",
]


@pytest.fixture(scope="module")
def files():
    return alignment.Vocabularies(queries.vocabulary(), queries.content(queries.PIECES))


def texts():
    rng = random.Random(4)
    return ODD + ["".join(rng.choice("ab \n\t'sé1.▁ ") for _ in range(rng.randrange(60))) for _ in range(200)]


def rows(df):
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted(((r.doc_id, *[r[c] for c in columns]) for r in df.collect()), key=repr)


def test_against_whole_texts(spark, files):
    all_texts = [*texts(), "the cat", "the cat", "the cat"]
    ids = [*range(len(all_texts) - 3), None, 3, 3]
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in zip(ids, all_texts)], "doc_id long, text string, n_a int, row string")
    got = alignment.align_corpus(docs, files, materialize)
    assert {"doc_id", "row", "n_a"} <= set(got.columns) and got.where("row <> 'x'").count() == 0
    assert rows(got) == sorted(((i, *r) for i, r in zip(ids, brute.alignment(all_texts, files.a_json, files.b_model))), key=repr)


def test_frequent_and_rare_pairs_meet_the_same_counts(spark, files, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    want = rows(alignment.align_corpus(docs, files, materialize))
    monkeypatch.setattr(alignment, "HOT", 3)  # nearly all pairs go through the shuffle
    assert rows(alignment.align_corpus(docs, files, materialize)) == want


def test_small_chunks_and_tables(files, monkeypatch):
    whole = alignment.Aligner(files).align(texts())
    monkeypatch.setattr(alignment, "CACHE_WORDS", 3)
    monkeypatch.setattr(alignment, "CACHE_CHARS", 2)
    small = alignment.Aligner(files)
    parts = [small.align([t]) for t in texts()]
    assert [x for p in parts for x in p.to_pylist()] == whole.to_pylist()


@pytest.mark.parametrize("step", [1, 2, 3, 7, 64, 1 << 20])
def test_pieces_of_any_size_merge_alike(step):
    rng = np.random.default_rng(step)
    for _ in range(30):
        n = int(rng.integers(1, 200))
        a = np.unique(np.append(rng.integers(1, n + 1, rng.integers(0, n + 1)), n))
        b = np.unique(np.append(rng.integers(1, n + 1, rng.integers(0, n + 1)), n))
        x, y, both = (np.concatenate(p) for p in zip(*alignment.overlaps(a, b, step)))
        ends = np.union1d(a, b)
        assert (x == np.searchsorted(a, ends)).all() and (y == np.searchsorted(b, ends)).all()
        assert (both == (np.isin(ends, a) & np.isin(ends, b))).all()


def test_nothing_to_align(spark, files):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align_corpus(empty, files, materialize).collect() == []
    none = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert rows(alignment.align_corpus(none, files, materialize)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_registered_query(spark, files, tmp_path):
    every = texts()
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(every)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    got = queries.op12_alignment(spark, str(tmp_path))
    assert rows(got) == sorted(((i, *r) for i, r in enumerate(brute.alignment(every, files.a_json, files.b_model))), key=repr)
