"""Words and windows that collide under plain polynomial hashes stay apart."""

import brute
import numpy as np
import pytest

from docframe.llm import decontaminate, near_dedup, substring_dedup, token_counts
from docframe.llm.words import BLANKS, Words, ranges
from docframe.session import materialize


def twins(n, a="a", b="b"):
    """The two sequences by which every odd base collides modulo 2**64 from some length on."""
    x = y = ""
    for i in range(n):
        one = bin(i).count("1") % 2
        x, y = x + (b if one else a), y + (a if one else b)
    return x, y


@pytest.mark.parametrize("n", [64, 1024, 2048, 4096, 16384])
def test_words_of_two_letters(n):
    x, y = twins(n)
    w = Words([f"{x} {y} {x}"], BLANKS)
    for kind in (0, 1):
        h = w.hashes(kind)
        assert h[0] == h[2] != h[1]
    assert w.hashes(0)[0] != w.hashes(1)[0]


def test_same_letters_at_other_places():
    w = Words(["ab ba aab aba baa a b aa bb", "ab"], BLANKS)
    assert len(set(w.hashes().tolist())) == 9 and w.hashes()[0] == w.hashes()[9]
    assert ranges(w.hashes(), np.array([0, 1]), np.array([2, 3])).tolist()[0] != ranges(w.hashes(), np.array([0, 1]), np.array([2, 3])).tolist()[1]


def documents():
    x, y = twins(1024)
    words = [f"w{i}" for i in range(30)]
    first, second = words[:], words[:]
    first[6], second[6] = x, y
    return [(1, " ".join(first[:12])), (2, " ".join(second[:12])), (3, f"{x} {y}")]


def test_substring(spark):
    docs = documents()
    out = substring_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), materialize, window=12)
    assert sorted((r.doc_id, r.n_words, r.n_removed, brute.sha(r.kept)) for r in out.collect()) == sorted(brute.substring(docs, 12))


def test_benchmark_passages(spark):
    docs = documents()
    items = [("i", docs[1][1]), ("j", docs[2][1].split()[1])]
    found = decontaminate.decontaminate(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"), materialize
    )
    got = sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in found.collect())
    assert got == [(1, 12, 0, []), (2, 12, 12, ["i", "j"]), (3, 2, 1, ["j"])]


def test_token_counts():
    x, y = twins(1024, "a", "Ġ")
    automaton = token_counts.build([bytes([b]) for b in range(256)] + [b" a", b"aa"])
    both = token_counts.count_texts(automaton, [f"{x} {y}", x, y])
    assert both[1][0] == both[1][1] + both[1][2]


def test_near_duplicates(spark):
    x, y = twins(1024)
    docs = [(1, x), (2, y), (3, x)]
    got = near_dedup.classes(spark.createDataFrame(docs, "doc_id long, text string"), materialize)
    assert sorted((r.doc_id, r.class_id) for r in got.collect()) == [(1, 1), (2, 2), (3, 1)]


def test_text_ids_and_null_ids(spark):
    docs = [("a", "one two three four five six seven eight nine ten eleven"), (None, "zero one two three four five six seven eight nine ten"), (None, "nothing here"), ("5", None)]
    items = [(7, "one two three four five six seven eight nine ten")]
    found = decontaminate.decontaminate(
        spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(items, "item_id long, text string"), materialize
    )
    assert sorted(((r.doc_id, r.n_hit) for r in found.collect()), key=repr) == sorted([("a", 10), (None, 10), (None, 0), ("5", 0)], key=repr)
