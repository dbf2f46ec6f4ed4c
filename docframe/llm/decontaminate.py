"""Benchmark decontamination with a distributed positional inverted index.

The index stores every token of the training texts: per block of documents and bucket
of terms, the terms, their counts and their postings (document, position), sorted by
term, delta-coded and compressed. A query reads the counts of the test terms, picks the
rarest term of each window of the test texts (and the second where its list is not much
longer), reads the lists of these terms only, subtracts the term's offset and intersects
the lists. What remains are alignments of a test text with a document; they are checked
word by word for exact phrases. ``proximity_matches`` returns near phrases from the same
lists.

Words are lower-cased (A-Z) runs of characters that are no ASCII controls, blanks or
punctuation. A test text shorter than a window is one window.

Defined results: null texts and texts without words match nothing and have 0 words;
test rows without id are ignored. Rows that repeat a document id are checked each by
its own text; repeated test rows count once. Documents without id, and with ids that are
no longs, are looked up by a hash of their text. Empty tables give documents without hits, or
an empty result. Extra columns of the documents are passed on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.llm.words import NOT_ALNUM, Words, chunks, slices

WINDOW = 10
BUCKETS = 128
# A second list is intersected if it has at most this many times the postings of the first.
SECOND_LIST = 8

_INDEX = "bucket int, terms binary, counts binary, docs binary, places binary"


def _pack(x: np.ndarray) -> bytes:
    """Differences, by byte planes, compressed."""
    import zstandard

    d = np.diff(x, prepend=x.dtype.type(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(d.view(np.uint8).reshape(len(d), x.itemsize).T).tobytes())


def _unpack(raw: bytes, dtype: str, n: int) -> np.ndarray:
    import zstandard

    plane = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(np.dtype(dtype).itemsize, n)
    return np.cumsum(np.ascontiguousarray(plane.T).view(dtype).reshape(n), dtype=dtype)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(32)) % np.uint64(BUCKETS)


def _document(key: str, text: str) -> F.Column:
    """Number of a document in the lists: its id, or a hash of its text where the id is no long.
    Documents that share a number share candidates; each is checked by its own text."""
    return F.coalesce(F.expr(f"try_cast(`{key}` AS BIGINT)"), F.xxhash64(text))


def index_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings of all tokens; one row per block of documents and bucket of terms."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for i, j in chunks(texts):
                w = Words(texts[i:j], NOT_ALNUM, lower=True)
                h, sizes = w.hashes(), np.diff(w.first)
                doc = np.repeat(ids[i:j], sizes)
                place = np.arange(len(h)) - np.repeat(w.first[:-1], sizes)
                bucket = _bucket(h)
                order = np.lexsort((place, doc, h, bucket))
                h, doc, place, bucket = h[order], doc[order], place[order].astype(np.int32), bucket[order]
                edges = np.searchsorted(bucket, np.arange(BUCKETS + 1, dtype=np.uint64))
                rows = []
                for b in range(BUCKETS):
                    lo, hi = edges[b], edges[b + 1]
                    if lo < hi:
                        terms, n = np.unique(h[lo:hi], return_counts=True)
                        rows.append((b, terms.tobytes(), n.astype(np.int32).tobytes(), _pack(doc[lo:hi].astype(np.int64)), _pack(place[lo:hi])))
                if rows:
                    cols = list(zip(*rows))
                    kinds = [pa.int32()] + [pa.binary()] * 4
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["bucket", "terms", "counts", "docs", "places"])

    return docs.select(_document(key, text), F.col(text)).mapInArrow(build, _INDEX)


def test_words(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct test texts with words: item, words (two hashes of 8 bytes each: all first ones, then all second ones)."""

    @F.pandas_udf("binary")
    def hashed(texts: pd.Series) -> pd.Series:
        w = Words([t for t in texts], NOT_ALNUM, lower=True)
        h, h2 = w.hashes(), w.hashes(1)
        return pd.Series([h[a:b].tobytes() + h2[a:b].tobytes() for a, b in zip(w.first, w.first[1:])])

    rows = items.select(F.col(key).cast("string").alias("item"), F.col(text).alias("t")).where("item IS NOT NULL AND t IS NOT NULL").distinct()
    return rows.select("item", hashed("t").alias("words")).where("length(words) > 0")


def _lookup(index: DataFrame, wanted: DataFrame, columns: list[str], read: Callable, schema: str) -> DataFrame:
    """Join the blocks of the index with the wanted terms (column h) of their bucket and read them."""

    @F.pandas_udf("int")
    def bucket_of(h: pd.Series) -> pd.Series:
        return pd.Series(_bucket(h.to_numpy().view(np.uint64)).astype(np.int32))

    @F.pandas_udf("binary")
    def packed(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: np.sort(np.asarray(x, np.int64).view(np.uint64)).tobytes())

    lists = wanted.select("h").distinct().withColumn("bucket", bucket_of("h")).groupBy("bucket").agg(F.collect_set("h").alias("hs"))
    lists = lists.select("bucket", packed("hs").alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for row in batch.to_pylist():
                want = np.frombuffer(row["wanted"], np.uint64)
                terms, n = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["counts"], np.int32)
                at = np.searchsorted(terms, want)
                at[at == len(terms)] = 0
                at = at[terms[at] == want]
                if len(at):
                    yield read(row, terms, n, at)

    joined = index.select("bucket", "terms", "counts", *columns).join(lists, "bucket").drop("bucket")
    return joined.mapInArrow(run, schema)


def term_counts(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Occurrences of the wanted terms in all documents: h, n."""

    def read(row: dict, terms: np.ndarray, n: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(terms[at].view(np.int64)), pa.array(n[at].astype(np.int64))], ["h", "n"])

    return _lookup(index, wanted, [], read, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def postings(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Lists of the wanted terms: h, doc, place."""

    def read(row: dict, terms: np.ndarray, n: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        total, end = int(n.sum()), np.cumsum(n)
        doc, place = _unpack(row["docs"], "int64", total), _unpack(row["places"], "int32", total)
        take = np.concatenate([np.arange(end[k] - n[k], end[k]) for k in at])
        h = np.repeat(terms[at].view(np.int64), n[at])
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(doc[take]), pa.array(place[take])], ["h", "doc", "place"])

    return _lookup(index, wanted, ["docs", "places"], read, "h long, doc long, place int")


def _terms(items: DataFrame) -> DataFrame:
    """item, off, h of every word of the test texts."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, raw in zip(batch.column("item").to_pylist(), batch.column("words").to_pylist()):
                h = np.frombuffer(raw, np.int64)[: len(raw) // 16]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(h), pa.string()), pa.array([raw] * len(h), pa.binary()), pa.array(np.arange(len(h), dtype=np.int32)), pa.array(h)],
                    ["item", "words", "off", "h"],
                )

    return items.mapInArrow(spread, "item string, words binary, off int, h long")


def anchors(items: DataFrame, index: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rarest terms to look up: item, words, first and second (offset, h); second is null where its list is long.

    Windows that hold a word the index lacks cannot occur and have no anchor."""
    terms = _terms(items)
    counted = terms.join(term_counts(index, terms), "h", "left").groupBy("item", "words").agg(
        F.array_sort(F.collect_list(F.struct("off", "h", F.coalesce("n", F.lit(0)).alias("n")))).alias("t")
    )

    @F.pandas_udf("array<struct<first:int,first_h:long,second:int,second_h:long>>")
    def pick(rows: pd.Series) -> pd.Series:
        out = []
        for row in rows:
            t = [(int(x["n"]), int(x["off"]), int(x["h"])) for x in row]
            found = set()
            for a in range(max(1, len(t) - window + 1)):
                rare = sorted(t[a : a + window])[:2]
                if rare[0][0]:
                    both = len(rare) > 1 and rare[1][0] <= SECOND_LIST * rare[0][0]
                    found.add((*rare[0][1:], *(rare[1][1:] if both else (None, None))))
            out.append([dict(zip(("first", "first_h", "second", "second_h"), f)) for f in found])
        return pd.Series(out)

    return counted.select("item", "words", F.explode(pick("t")).alias("a")).select("item", "words", "a.*")


def alignments(items: DataFrame, index: DataFrame, scratch: Callable[[DataFrame], DataFrame], window: int = WINDOW) -> DataFrame:
    """Places where the intersected lists agree: doc, item, words, at (the word where the test text would begin)."""
    picked = scratch(anchors(items, index, window).withColumn("test", F.xxhash64("item", "words")))
    one = picked.select("test", F.col("first").alias("off"), F.col("first_h").alias("h"))
    two = picked.where("second IS NOT NULL").select("test", F.col("second").alias("off"), F.col("second_h").alias("h"))
    wanted = one.unionByName(two).distinct()
    lists = postings(index, wanted).join(wanted, "h").select("doc", "test", "off", (F.col("place") - F.col("off")).alias("at"))
    seen = lists.groupBy("doc", "test", "at").agg(F.collect_set("off").alias("offs"))
    pairs = picked.groupBy("test", "item", "words").agg(F.collect_set(F.struct("first", F.coalesce("second", "first").alias("second"))).alias("pairs"))
    fits = F.exists("pairs", lambda p: F.array_contains("offs", p["first"]) & F.array_contains("offs", p["second"]))
    return seen.join(pairs, "test").where(fits).select("doc", "item", "words", "at")


def proximity_matches(items: DataFrame, index: DataFrame, slop: int, scratch: Callable[[DataFrame], DataFrame], window: int = WINDOW) -> DataFrame:
    """Documents where the two rarest terms of a window stand at most ``slop`` words from their distance in the
    test text: item, doc, first_place, second_place."""
    picked = scratch(anchors(items, index, window).where("second IS NOT NULL"))
    wanted = picked.select(F.col("first_h").alias("h")).union(picked.select("second_h")).distinct()
    lists = scratch(postings(index, wanted))
    cell = slop + 1
    first = lists.join(picked.withColumnRenamed("first_h", "h"), "h").select(
        "item", "doc", "first", "second", "second_h", F.col("place").alias("first_place"),
        F.explode(F.array(*[F.floor((F.col("place") - F.col("first")) / cell) + d for d in (-1, 0, 1)])).alias("cell"),
    )
    second = lists.select("doc", F.col("h").alias("second_h"), F.col("place").alias("second_place"))
    spread = second.join(picked.select("item", "first", "second", "second_h"), "second_h").withColumn(
        "cell", F.floor((F.col("second_place") - F.col("second")) / cell)
    )
    apart = F.abs((F.col("second_place") - F.col("second")) - (F.col("first_place") - F.col("first"))) <= slop
    return first.join(spread, ["item", "doc", "first", "second", "second_h", "cell"]).where(apart).select(
        "item", "doc", "first_place", "second_place"
    ).distinct()


def decontaminate(
    docs: DataFrame, items: DataFrame, scratch: Callable[[DataFrame], DataFrame], key: str = "doc_id", text: str = "text",
    item_key: str = "item_id", item_text: str = "text", window: int = WINDOW,
) -> DataFrame:
    """Add ``n_words``, ``n_hit`` (words inside an occurring window) and ``items`` (sorted ids of the test texts)."""
    tested = test_words(items, item_key, item_text)
    index = scratch(index_documents(docs, key, text))
    found = alignments(tested, index, scratch, window)
    by_doc = found.groupBy(F.col("doc").alias("_doc")).agg(F.collect_set(F.struct("item", "words", "at")).alias("_found"))
    own = ["n_words", "n_hit", "items"]
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in own], _document(key, text).alias("_doc"))
    joined = rows.join(by_doc, "_doc", "left")

    @F.pandas_udf("n_words long, n_hit long, items array<string>")
    def check(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, found in batches:
            out = []
            texts = [None if t is None else t for t in texts]
            for i, j in chunks(texts):
                w = Words(texts[i:j], NOT_ALNUM, lower=True)
                for k, (a, b) in enumerate(zip(w.first.tolist(), w.first[1:].tolist()), i):
                    f = found.iloc[k]
                    if f is None or not len(f):
                        out.append((b - a, 0, []))
                        continue
                    one = Words([texts[k]], NOT_ALNUM, lower=True)  # only texts with alignments are hashed
                    out.append((b - a, *_hits(one.hashes(), one.hashes(1), f, window)))
            yield pd.DataFrame(out, columns=own)

    return joined.withColumn("_c", check(F.col(text), F.col("_found"))).select("*", *[F.col(f"_c.{c}") for c in own]).drop("_c", "_found", "_doc")


def _hits(h: np.ndarray, h2: np.ndarray, found, window: int) -> tuple[int, list[str]]:
    """Words of a document inside occurring windows, and the test texts that have them."""
    hit, items = np.zeros(len(h), bool), set()
    for f in found:
        test, test2 = np.frombuffer(f["words"], np.uint64).reshape(2, -1)
        size, at = min(window, len(test)), int(f["at"])
        lo, hi = max(0, -at), min(len(test), len(h) - at)
        if hi - lo < size:
            continue
        same = np.concatenate(([0], np.cumsum((test[lo:hi] != h[at + lo : at + hi]) | (test2[lo:hi] != h2[at + lo : at + hi]))))
        for s in np.flatnonzero(same[size:] == same[:-size]).tolist():
            hit[at + lo + s : at + lo + s + size] = True
            items.add(f["item"])
    return int(hit.sum()), sorted(items)
