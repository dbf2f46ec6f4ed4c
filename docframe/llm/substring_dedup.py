"""Exact substring deduplication by level-wise doubling of repeated windows.

Windows of ``window`` words that occur twice are found from shorter ones: only places
whose window repeats at one length are looked at again at twice that length, until the
wanted length is reached or no candidate is left.

The first level has half the wanted length and keeps one place in about ten: the anchor
of a full window is the half-length window with the smallest hash in it (the first of
equal ones), so equal full windows have equal anchors at equal offsets. Consecutive full
windows with one anchor form a piece. A piece that occurs twice as a whole repeats in all
its windows and needs no further look; of each different piece with a repeated anchor,
one copy is extended to full windows, which are counted. A piece has at most
``window - half + 1`` windows, so its result is the bits of one long.

All keys are 128-bit hashes of words. Counts are combined before they are shuffled, and
what a common passage makes frequent is joined between two plain shuffles that Spark can
split. Texts meet their pieces once, by document.

Defined results: words are runs of characters other than ASCII blanks, unchanged. A null
text has no words and keeps none; texts shorter than a window keep all. Repeated rows
repeat each other's windows and lose them all. Documents without id are told apart by
their texts. An empty table gives an empty result. Extra columns are passed on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.llm.words import BLANKS, Words, chunks, ranges

WINDOW = 35
_PIECE = "doc long, at int, n int, anchor long, f1 long, f2 long"


def _first_minimum(v: np.ndarray, width: int) -> np.ndarray:
    """Index of the first smallest value among ``v[i : i + width]``, for each i, by doubling."""
    at, value, span = np.arange(len(v)), v, 1
    while span < width:
        step = min(span, width - span)
        left, right = value[:-step], value[step:]
        second = right < left
        at, value = np.where(second, at[step:], at[:-step]), np.where(second, right, left)
        span += step
    return at


def pieces(h: np.ndarray, h2: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Runs of full windows with one anchor: text, first window (word in the text), windows, anchor hash and 128-bit hash."""
    half = (window + 1) // 2
    n = len(h)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none, none, none, none
    short = np.arange(n - half + 1)
    anchor_hash = ranges(h, short, short + half)
    anchor = _first_minimum(anchor_hash, window - half + 1)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(anchor)]
    inside = np.arange(len(anchor)) + window <= first[1:][text]
    fresh = np.ones(len(anchor), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1]
    begin = np.flatnonzero(fresh & inside)
    owner = np.cumsum(fresh & inside)[inside] - 1
    count = np.bincount(owner, minlength=len(begin))
    end = begin + count - 1 + window
    signed = [x.view(np.int64) for x in (anchor_hash[anchor[begin]], ranges(h, begin, end), ranges(h2, begin, end, 1))]
    return (text[begin], begin - first[text[begin]], count, *signed)


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Text and two-part key: a document is known by its id and its text."""
    return docs.select(F.xxhash64(F.col(key), F.col(text)).alias("doc"), F.col(text).alias("t"))


def _pieces_of(docs: DataFrame, window: int) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for i, j in chunks(texts):
                w = Words(texts[i:j], BLANKS)
                text, at, n, *keys = pieces(w.hashes(), w.hashes(1), w.first, window)
                cols = [pa.array(ids[i:j][text]), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), *map(pa.array, keys)]
                yield pa.RecordBatch.from_arrays(cols, ["doc", "at", "n", "anchor", "f1", "f2"])

    return docs.mapInArrow(find, _PIECE)


def _windows_of(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """Full windows of the wanted pieces (doc, picks): f1, f2, off, w1, w2."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, picks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j in chunks(texts):
                w = Words(texts[i:j], BLANKS)
                both = w.hashes(), w.hashes(1)
                rows = [(p["f1"], p["f2"], f + p["at"], p["n"]) for f, ps in zip(w.first.tolist(), picks[i:j]) for p in ps]
                f1, f2, at, n = (np.array(c, np.int64) for c in zip(*rows))
                off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = np.repeat(at, n) + off
                w1, w2 = (ranges(both[k], start, start + window, k).view(np.int64) for k in (0, 1))
                cols = [np.repeat(f1, n), np.repeat(f2, n), off.astype(np.int32), w1, w2]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["f1", "f2", "off", "w1", "w2"])

    picks = wanted.groupBy("doc").agg(F.collect_list(F.struct("f1", "f2", "at", "n")).alias("picks"))
    return docs.join(picks, "doc").select("t", "picks").mapInArrow(extend, "f1 long, f2 long, off int, w1 long, w2 long")


def repeated_pieces(docs: DataFrame, scratch: Callable[[DataFrame], DataFrame], window: int = WINDOW) -> DataFrame:
    """Pieces with repeated windows: f1, f2 and ``bits``, bit i set if the window at offset i repeats.

    ``docs`` has columns doc and t. Levels: anchors of half the length, then full windows."""
    one = F.struct("doc", "at", "n", "anchor")
    distinct = scratch(
        _pieces_of(docs, window)
        .groupBy("f1", "f2")
        .agg(F.count("*").alias("copies"), F.min(one).alias("p"))
        .select("f1", "f2", "copies", "p.*")
    )
    anchors = scratch(distinct.groupBy("anchor").agg(F.count("*").alias("shapes")).where("shapes > 1").select("anchor"))
    candidates = distinct.join(anchors, "anchor")
    windows = scratch(_windows_of(docs, candidates, window))
    frequent = scratch(windows.groupBy("w1", "w2").agg(F.count("*").alias("c")).where("c > 1").select("w1", "w2"))
    extended = windows.join(frequent, ["w1", "w2"]).groupBy("f1", "f2").agg(F.expr("bit_or(shiftleft(1L, off))").alias("bits"))
    whole = distinct.where("copies > 1").select("f1", "f2", F.expr("shiftleft(1L, n) - 1").alias("bits"))
    return scratch(whole.unionByName(extended).groupBy("f1", "f2").agg(F.expr("bit_or(bits)").alias("bits")))


def repeated_spans(docs: DataFrame, scratch: Callable[[DataFrame], DataFrame], window: int = WINDOW) -> DataFrame:
    """Per document (columns doc and t) the windows that repeat: doc, spans of (at, bits)."""
    bits = repeated_pieces(docs, scratch, window)
    found = _pieces_of(docs, window).select("doc", "at", "f1", "f2").join(bits, ["f1", "f2"])
    return found.groupBy("doc").agg(F.collect_set(F.struct("at", "bits")).alias("spans"))


def remove_repeats(
    docs: DataFrame, scratch: Callable[[DataFrame], DataFrame], key: str = "doc_id", text: str = "text", window: int = WINDOW
) -> DataFrame:
    """Add ``n_words``, ``n_removed`` and ``kept`` (the other words joined by one blank)."""
    if not 2 <= window <= 100:
        raise ValueError("a window has 2 to 100 words")
    spans = repeated_spans(_keyed(docs, key, text), scratch, window)
    own = ["n_words", "n_removed", "kept"]
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in own], F.xxhash64(F.col(key), F.col(text)).alias("_doc"))
    joined = rows.join(spans.withColumnRenamed("doc", "_doc").withColumnRenamed("spans", "_spans"), "_doc", "left")

    @F.pandas_udf("n_words long, n_removed long, kept string")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, spans in batches:
            texts = [None if t is None else t for t in texts]
            out = []
            for i, j in chunks(texts):
                w = Words(texts[i:j], BLANKS)
                raw = w.buf.tobytes()
                start, end = w.start.tolist(), w.end.tolist()
                for a, b, s in zip(w.first.tolist(), w.first[1:].tolist(), spans.iloc[i:j]):
                    gone = covered(b - a, s, window)
                    keep = (np.flatnonzero(~gone) + a).tolist()
                    out.append((b - a, int(gone.sum()), b" ".join([raw[start[k] : end[k]] for k in keep]).decode()))
            yield pd.DataFrame(out, columns=own)

    return joined.withColumn("_cut", cut(F.col(text), F.col("_spans"))).select("*", *[F.col(f"_cut.{c}") for c in own]).drop("_cut", "_spans", "_doc")


def covered(n: int, spans, window: int) -> np.ndarray:
    """Words inside a repeated window, from (at, bits) pairs."""
    edge = np.zeros(n + 1, np.int64)
    for s in spans if spans is not None else ():
        at, bits = int(s["at"]), int(s["bits"])
        while bits:
            low = (bits & -bits).bit_length() - 1
            edge[at + low] += 1
            edge[at + low + window] -= 1
            bits &= bits - 1
    return np.cumsum(edge)[:n] > 0
