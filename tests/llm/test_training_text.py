"""Each operator against a plain version on small rows with nulls, empty texts, ties and repeats."""

import random
from collections import Counter

import brute
import numpy as np
import pytest

from docframe.llm import (
    bpe, components, decontaminate, language_id, line_dedup, near_dedup, nearest, queries, sharding, substring_dedup, token_counts, url_filter,
)
from docframe.session import materialize

WORDS = "the of and thing erst naïve über niño été one two three four five six seven".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randrange(0, 60)) + "\n" + prose(rng, 8)) for i in range(60)]
    shared = prose(rng, 40)
    rows += [(100 + i, f"{prose(rng, 9)} {shared}\n{prose(rng, 30)}") for i in range(6)]
    rows += [(200, None), (201, ""), (202, " \t\n "), (203, rows[3][1]), (204, rows[3][1]), (205, "x" * 3000), (None, rows[4][1]), (206, "ab " * 5000)]
    return rows


@pytest.fixture(scope="module")
def frame(spark, docs):
    return spark.createDataFrame([(k, t, "kept", 1) for k, t in docs], "doc_id long, text string, source string, n_words int")


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_substring(frame, docs):
    out = substring_dedup.remove_repeats(frame, materialize, window=12)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, brute.sha(r.kept)) for r in out.collect()), key=repr)
    assert got == sorted(brute.substring(docs, 12), key=repr)
    assert "source" in out.columns


def test_substring_of_repetitive_words(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(0, 40)))) for i in range(40)]
    out = substring_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), materialize, window=7)
    assert sorted((r.doc_id, r.n_words, r.n_removed, brute.sha(r.kept)) for r in out.collect()) == sorted(brute.substring(docs, 7))


def test_lines_with_big_groups(spark):
    rng, base = random.Random(3), "the quick brown fox jumps over it"

    def changed(s, n):
        s = list(s)
        for _ in range(n):
            i = rng.randrange(len(s))
            s[i : i + rng.choice((0, 1))] = rng.choice(("", "a", "é"))
        return "".join(s)

    docs = [(i, "\n".join(changed(base, rng.choice([0, 1, 1, 2])) for _ in range(4))) for i in range(120)]
    docs += [(300 + i, changed("a" * 24, rng.choice([1, 2]))) for i in range(60)] + [(500, None), (501, ""), (502, "x\n \n\nx")]
    out = line_dedup.remove_lines(spark.createDataFrame(docs, "doc_id long, text string"), materialize)
    got = {r.doc_id: (r.n_lines, r.exact, r.near) for r in out.collect()}
    assert got == {k: (n, e, c) for k, n, e, c in brute.lines(docs)}


def test_token_counts(frame, docs):
    pieces = token_counts.byte_pieces(queries.vocabulary())
    known, longest = set(pieces), max(map(len, pieces))
    out = token_counts.count_tokens(frame, pieces)
    assert rows_of(out, "doc_id", "n_words", "n_tokens") == sorted(((k, *brute.pieces(t, known, longest)) for k, t in docs), key=repr)


def test_bpe_round_trip(spark, docs):
    from tokenizers import Tokenizer

    code = queries.vocabulary()
    texts = docs + [(300, "it's <|endoftext|> a\u00a0b \u1c89\u0558 x"), (301, "日本語 12 \U0001f600!!")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    out = bpe.decode(bpe.encode(df, code, table_words=5), code)
    library = Tokenizer.from_str(code)
    want = [(k, library.encode(t or "", add_special_tokens=False).ids, t or "") for k, t in texts]
    assert sorted(((r.doc_id, r.token_ids, r.decoded) for r in out.collect()), key=repr) == sorted(want, key=repr)


def test_bpe_digests_in_one_process(spark):
    code = queries.vocabulary()
    texts = [(1, "The cat\u2019s 12 cats"), (2, None), (3, ""), (3, ""), (None, "\u65e5\u672c <|endoftext|> \x85x"), (5, "rareword" * 40)]
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "'given' AS n_tokens", "doc_id AS extra").coalesce(1)
    one = bpe.encode(df, code, table_words=3, digested=True)
    two = bpe.digests(bpe.encode(df, code, table_words=3), code)
    assert one.dtypes == two.dtypes and sorted(one.collect(), key=repr) == sorted(two.collect(), key=repr)
    # A second evaluation in Python means a second process beside each task's first.
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_decontaminate(spark, frame, docs):
    texts = [t for _, t in docs if t]
    items = [("a", texts[2]), ("b", " ".join(texts[62].upper().split()[10:30])), ("c", "one two"), ("d", None), ("e", ""), (None, texts[5]), ("c", "one two")]
    df = spark.createDataFrame(items, "item_id string, text string")
    out = decontaminate.decontaminate(frame, df, materialize)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, len(r["items"]), brute.sha(",".join(r["items"])), r.n_hit > 0) for r in out.collect()), key=repr)
    assert got == sorted(brute.decontaminate(docs, [i for i in items if i[0]]), key=repr)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta"), (2, "alpha x y z q r s beta"), (3, "beta")], "doc_id long, text string")
    items = decontaminate.test_words(spark.createDataFrame([("i", "alpha beta")], "item_id string, text string"))
    index = materialize(decontaminate.index_documents(docs))
    assert [r.doc for r in decontaminate.proximity_matches(items, index, 2, materialize).collect()] == [1]


def test_near_duplicates(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(80)]
    near = list(base)
    near[40] = "changed"
    rows = [(5, " ".join(base)), (3, " ".join(near)), (4, " ".join(base)), (7, " ".join(rng.choice(words) for _ in range(80))), (8, None), (9, None), (10, ""), (11, "")]
    got = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string"), materialize).collect()}
    assert got == {5: 3, 3: 3, 4: 3, 7: 7, 8: 8, 9: 9, 10: 10, 11: 10}


def test_near_duplicates_in_a_large_group(spark):
    """Pairs that share a passage with many others and are similar only to each other."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(5000)]
    sketch = rng.sample(range(10**9), 16)
    rows, sketched = [], []
    for i in range(60):
        base = [rng.choice(words) for _ in range(60)]
        near = list(base)
        near[20] = "changed"
        rows += [(2 * i, base), (2 * i + 1, near)]
    index = {w: n for n, w in enumerate([*words, "changed"])}
    packed = [(i, bytearray(np.array([index[w] for w in t], np.uint32).tobytes())) for i, t in rows]
    table = spark.createDataFrame(packed, "id long, words binary")
    sketched = spark.createDataFrame([(i, sketch[:1]) for i, _ in rows], "id long, sketch array<long>")
    got = near_dedup.linked(sketched, lambda ids: table.join(ids, "id"), 0.8, materialize)
    assert sorted(map(tuple, got.collect())) == [(2 * i, 2 * i + 1) for i in range(60)]


def test_chain_in_a_large_group(spark):
    """Each text is similar to its neighbours only; a text that is linked early still links the next one."""
    chains = [[f"c{c}w{i}" for i in range(400)] for c in range(3)]
    texts = [chain[3 * i : 3 * i + 60] for chain in chains for i in range(100)]
    index = {w: n for n, w in enumerate(w for chain in chains for w in chain)}
    packed = [(i, bytearray(np.array([index[w] for w in t], np.uint32).tobytes())) for i, t in enumerate(texts)]
    table = spark.createDataFrame(packed, "id long, words binary")
    sketched = spark.createDataFrame([(i, [7]) for i in range(300)], "id long, sketch array<long>")
    links = near_dedup.linked(sketched, lambda ids: table.join(ids, "id"), 0.8, materialize)
    assert all(a // 100 == b // 100 and b - a <= 2 for a, b in links.collect())
    roots = {r.id: r.root for r in components.components(links, materialize).collect()}
    assert roots == {i: i // 100 * 100 for i in range(300)}


def test_pairs_of_a_large_group_of_near_copies(spark, monkeypatch):
    """Near copies that share all sketches are compared with one text, not with some of every sketch."""
    rng = random.Random(8)
    rows = []
    for i in range(150):
        near = list(range(100))
        near[rng.randrange(100)] = 1000 + i
        rows.append((i, bytearray(np.array(near, np.uint32).tobytes())))
    table = spark.createDataFrame(rows, "id long, words binary")
    sketched = spark.createDataFrame([(i, list(range(16))) for i in range(150)], "id long, sketch array<long>")
    compared = []
    plain = near_dedup.verified
    monkeypatch.setattr(near_dedup, "verified", lambda pairs, *rest: compared.append(pairs.count()) or plain(pairs, *rest))
    links = near_dedup.linked(sketched, lambda ids: table.join(ids, "id"), 0.8, materialize)
    roots = {r.id: r.root for r in components.components(links, materialize).collect()}
    assert roots == dict.fromkeys(range(150), 0)
    assert sum(compared) < 300


def test_word_pairs_of_a_tile():
    rng = random.Random(9)
    held = [np.array([rng.randrange(4) for _ in range(rng.choice([0, 1, 2, 9, 30]))], np.uint32) for _ in range(40)]
    tile = near_dedup.Tile(held)
    pairs = [Counter(zip(w.tolist(), w.tolist()[1:])) for w in held]
    for i in range(40):
        assert tile.shared(i).tolist() == [(pairs[i] & other).total() for other in pairs[i + 1 :]]


def test_edit_distance():
    rng = random.Random(4)
    for _ in range(400):
        a, b = ([rng.randrange(3) for _ in range(rng.randrange(0, 14))] for _ in range(2))
        for limit in (0, 2, 5, 20):
            assert near_dedup.edit_distance(np.array(a, np.uint32), np.array(b, np.uint32), limit) == min(brute.edits(a, b), limit + 1)


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51), (51, 52), (50, 52)], "a long, b long")
    got = {r.id: r.root for r in components.components(links, materialize).collect()}
    assert got == {**dict.fromkeys(range(21), 0), **dict.fromkeys((50, 51, 52), 50)}


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 8)).round(2).astype(np.float32)
    x[50:60] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, None), (301, [0.0] * 8), (302, [float("nan")] * 8), (303, [None] * 8), (304, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in nearest.search(df, df.where("vec_id % 20 = 0"), 5, materialize).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    found = 0
    for q in range(0, 200, 20):
        s = np.array([sum(float(a) * float(b) for a, b in zip(x[q], v)) for v in x])
        s[q] = -np.inf
        want = np.lexsort((np.arange(200), -s))[:5]
        found += len({v for v, _ in got[q].values()} & set(want.tolist()))
        assert all(abs(score - s[v]) < 1e-12 for v, score in got[q].values())
        order = [got[q][i] for i in range(1, 6)]
        assert order == sorted(order, key=lambda v: (-v[1], v[0]))
    assert found >= 45


def test_nearest_of_repeated_rows(spark):
    """Copies of rows take no places: k different ids, as without the copies."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 8)).round(2).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    copied = rows * 2 + [rows[1]] * 28 + [(2, (-x[2]).tolist())] * 30
    asked = spark.createDataFrame(rows[:4], "vec_id long, embedding array<float>")

    def run(vectors, **kind):
        df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
        return rows_of(nearest.search(df, asked, 20, materialize, **kind), "query_id", "rank", "vec_id", "score")

    for kind in ({}, {"tables": 2, "probes": 1}):  # probed buckets, then the search of every row
        got = run(copied, **kind)
        assert got == run([*rows, (2, (-x[2]).tolist())], **kind)
        assert all(len({r[2] for r in got if r[0] == q}) == 20 for q in range(4))
    # Every row is searched: the result is the exact one.
    s = x.astype(float) @ x.astype(float).T
    s[:, 2] = np.abs(s[:, 2])
    for q in (0, 1, 3):
        s[q, q] = -np.inf
        assert {r[2] for r in got if r[0] == q} == set(np.lexsort((np.arange(120), -s[q].round(9)))[:20].tolist())


def test_sharding(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = sharding.shard(df, 4, materialize).collect()
    assert len(out) == len(docs)
    slots = {}
    for r in out:
        slots.setdefault(r["shard"], []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(4))
    texts = {}
    for r in out:
        texts.setdefault(r.text_crc32, set()).add(r["shard"])
    assert {r.text_crc32 for r in out} == {brute.crc(t) for _, t in docs}


def test_language(spark):
    rng = random.Random(8)
    vocab = {"en": "the of and was with from this that thing other".split(), "de": "der die das und nicht eine werden schön über auch".split()}
    rows = [(i, lang, " ".join(rng.choice(vocab[lang]) for _ in range(60))) for i, lang in enumerate(["en", "de"] * 40)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    out = language_id.classify(df, language_id.learn(df.where("doc_id < 40")))
    assert all(r.lang == r.lang_pred and not r.rejected for r in out.collect())
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !")], "doc_id long, text string")
    assert {(r.lang_pred, r.score, r.rejected) for r in language_id.classify(odd, {"en": b"the of and"}).collect()} == {("und", 0.0, True)}


def test_language_with_a_one_line_label(spark):
    """A label with one short line leaves the other dictionaries as they are."""
    rng = random.Random(8)
    vocab = {"en": "the of and was with from this that thing other".split(), "de": "der die das und nicht eine werden schön über auch".split()}
    rows = [(i, lang, " ".join(rng.choice(vocab[lang]) for _ in range(60))) for i, lang in enumerate(["en", "de"] * 40)]
    for odd in ("a", "ab cd", "one short line of its own"):
        df = spark.createDataFrame([*rows, (-1, "xx", odd)], "doc_id long, lang string, text string")
        learned = language_id.learn(df.where("doc_id < 40"))
        without = language_id.learn(df.where("doc_id BETWEEN 0 AND 39"))
        assert {k: learned[k] for k in without} == without
        out = language_id.classify(df.where("doc_id >= 0"), learned)
        assert all(r.lang == r.lang_pred and not r.rejected for r in out.collect())


def test_language_dictionaries_of_one_size(spark):
    rng = random.Random(9)
    letters = "abcdefghij"
    rows = [(lang, "".join(rng.choice(letters) for _ in range(1000))) for lang, n in (("aa", 40), ("bb", 20), ("cc", 3)) for _ in range(n)]
    got = language_id.learn(spark.createDataFrame(rows, "lang string, text string"))
    assert 0 <= len(got["aa"]) - len(got["bb"]) <= 1 and len(got["bb"]) >= language_id.LEAST_BYTES and 3000 <= len(got["cc"]) <= 3003


def test_urls(spark):
    urls = ["http://A.Example.ORG/es/1?x#y", "https://x.com", "no scheme", None, "a://b?c://d", "ftp://h/p//q#://"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    host, path = url_filter.host_and_path(df["url"])
    assert [tuple(r) for r in df.orderBy("page_id").select(host, path).collect()] == [brute.url(u) for u in urls]
    hosts = spark.createDataFrame([("bad.net", 1)] * 30 + [("good.net", 0)] * 30, "host string, bad int")
    out = url_filter.judge(df, url_filter.reputation(hosts), queries.RULES)
    assert {r.page_id: r.rule for r in out.collect()} == {0: "example.org/es/", 1: None, 2: None, 3: None, 4: None, 5: None}
    pages = spark.createDataFrame([(1, "http://bad.net/"), (2, "http://good.net/")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in url_filter.judge(pages, url_filter.reputation(hosts), []).collect()} == {1: "block", 2: "allow"}


def test_rules_of_the_contract(spark):
    urls = ["http://a.org/x", "http://example.org/es/1", "http://b.example.org/en/12", "http://c.com/fr/", "http://c.com/de/2"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([("a.org", 1)] * 30 + [("c.com", 1)] * 30, "host string, bad int")
    out = url_filter.judge(df, url_filter.reputation(labels), queries.RULES)
    assert {r.page_id: (r.rule, r.verdict) for r in out.collect()} == {
        0: ("org/", "allow"), 1: ("example.org/es/", "block"), 2: ("example.org/en/1", "block"), 3: ("com/fr/", "allow"), 4: ("com/de/", "block"),
    }


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id string, text string")
    assert substring_dedup.remove_repeats(none, materialize).count() == 0
    assert line_dedup.remove_lines(none, materialize).count() == 0
    assert near_dedup.classes(none, materialize).count() == 0
    assert decontaminate.decontaminate(none, items, materialize).count() == 0
    assert bpe.encode(none, queries.vocabulary()).count() == 0
    assert sharding.shard(none, 3, materialize).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest.search(vectors, vectors, 3, materialize).count() == 0
