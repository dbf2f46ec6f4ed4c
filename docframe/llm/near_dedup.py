"""Near-duplicate documents by order MinHash with verified links.

Equal texts are combined first. A text is a sequence of word 5-grams, each labelled with
its occurrence number. A sketch samples the few 5-grams with the smallest hashes and keeps
them in text order, so that its collision probability follows edit similarity rather than
set overlap (Marçais et al., 2019). Texts that share one of several sketches are
candidates. Groups of at most ``SMALL_GROUP`` texts are compared pair by pair. A larger group has
a representative, the text with the smallest hash. First every text is compared with one
representative, then, in groups that hold several classes of the links found so far, with that of
each of its groups. Then every two texts of a large group that no
chain of links joins yet are compared, in tiles of bounded size. Candidates are verified by
banded alignment of their words: 1 minus edits over the longer length must reach the threshold;
counts of shared words and word pairs rule out most others before.
Classes are the connected components of the links among all candidates; pairs that a
chain joins already are not compared, so ``n_links`` counts the links that were verified.

Texts with fewer than five words count as one gram of all their words.

Defined results: null texts are each a class of their own. Equal texts (empty ones too)
are one class. Texts without words match only equal texts. Repeated rows are copies of
each other. The class id is the smallest document id of the class, null where all are.
Empty tables give an empty result. Extra columns of the input play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.llm.components import components
from docframe.llm.words import BLANKS, U64, Words, chunks, mix, ranges

GRAM = 5
SAMPLED = 2  # grams of a sketch
SKETCHES = 16
THRESHOLD = 0.8
SMALL_GROUP = 8  # texts of a sketch compared pair by pair
TILE = 1024  # texts of a large group on one side of a tile
TILE_BYTES = 1 << 21  # of words (4 bytes each) on one side of a tile


def labelled_grams(h: np.ndarray, first: np.ndarray, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled gram hashes of each text, and where each text's begin (with the total)."""
    sizes = np.diff(first)
    n = np.where(sizes >= gram, sizes - gram + 1, np.minimum(sizes, 1))
    begin = np.concatenate(([0], np.cumsum(n)))
    text = np.repeat(np.arange(len(n)), n)
    start = first[:-1][text] + np.arange(begin[-1]) - begin[:-1][text]
    end = np.minimum(start + gram, first[1:][text])
    g = ranges(h, start, end)
    own = g ^ mix(text.astype(U64) + U64(1))
    order = np.argsort(own, kind="stable")
    s = own[order]
    fresh = np.concatenate(([True], s[1:] != s[:-1])) if len(s) else np.zeros(0, bool)
    run = np.arange(len(s)) - np.maximum.accumulate(np.where(fresh, np.arange(len(s)), 0)) if len(s) else s.astype(np.int64)
    nth = np.empty(len(s), np.int64)
    nth[order] = run
    return mix(g + nth.astype(U64) * U64(0x9E3779B97F4A7C15)), begin


def sketches(grams: np.ndarray, begin: np.ndarray, count: int = SKETCHES, sampled: int = SAMPLED) -> np.ndarray:
    """Sketches of each text with grams (rows of texts without grams are 0)."""
    out = np.zeros((len(begin) - 1, count), U64)
    some = np.flatnonzero(np.diff(begin))
    if not len(some):
        return out
    starts, size = begin[:-1][some], np.diff(begin)[some]
    for k in range(count):
        v = mix(grams ^ U64((k + 1) * 0xD6E8FEB86659FD93 % 2**64))
        at = []
        for _ in range(sampled):
            low = np.minimum.reduceat(v, starts)
            hit = np.flatnonzero(v == np.repeat(low, size))
            owner = np.searchsorted(starts, hit, "right") - 1
            place = np.full(len(some), -1, np.int64)
            place[owner[::-1]] = hit[::-1]
            v[place] = U64(2**64 - 1)
            at.append(place)
        value = np.zeros(len(some), U64)
        for place in np.sort(np.stack(at), axis=0):
            value = mix(value * U64(0x9E3779B97F4A7C15) + grams[place])
        out[some, k] = value
    return out


def edit_distance(a: np.ndarray, b: np.ndarray, limit: int) -> int:
    """Edits between two sequences, or limit + 1 if there are more."""
    n, m = len(a), len(b)
    if abs(n - m) > limit:
        return limit + 1
    common = min(n, m)
    miss = np.flatnonzero(a[:common] != b[:common])
    skip = int(miss[0]) if len(miss) else common
    a, b = a[skip:], b[skip:]
    common = min(len(a), len(b))
    miss = np.flatnonzero(a[len(a) - common :][::-1] != b[len(b) - common :][::-1])
    skip = int(miss[0]) if len(miss) else common
    a, b = a[: len(a) - skip], b[: len(b) - skip]
    n, m = len(a), len(b)
    if not n or not m:
        return min(max(n, m), limit + 1)
    values, na = np.unique(a, return_counts=True)
    at = np.searchsorted(values, b)
    at[at == len(values)] = 0
    shared = np.minimum(np.bincount(at[values[at] == b], minlength=len(values)), na).sum()
    if max(n, m) - shared > limit:
        return limit + 1
    # An edit spoils two pairs of neighbours at most.
    if max(n, m) - 1 > 2 * limit:
        pairs, nx = np.unique(_bigrams(a), return_counts=True)
        other, ny = np.unique(_bigrams(b), return_counts=True)
        _, x, y = np.intersect1d(pairs, other, assume_unique=True, return_indices=True)
        if max(n, m) - 1 - np.minimum(nx[x], ny[y]).sum() > 2 * limit:
            return limit + 1
    # Column by column, the vertical differences of all rows as bits of two integers (Myers, 1999).
    places: dict[int, int] = {}
    for i, word in enumerate(a.tolist()):
        places[word] = places.get(word, 0) | 1 << i
    every, top = (1 << n) - 1, 1 << (n - 1)
    up, down, edits = every, 0, n
    for left, word in zip(range(m - 1, -1, -1), b.tolist()):
        same = places.get(word, 0)
        across = (((same & up) + up) ^ up) | same
        rise, fall = down | (every & ~(across | up)), up & across
        if rise & top:
            edits += 1
            if edits - left > limit:
                return limit + 1
        elif fall & top:
            edits -= 1
        rise = rise << 1 | 1
        level = same | down
        up, down = (fall << 1 | ~(level | rise)) & every, rise & level & every
    return min(edits, limit + 1)


def similar(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    longer = max(len(a), len(b))
    limit = int(longer * (1 - threshold) + 1e-9)
    return longer > 0 and edit_distance(a, b, limit) <= limit


def _sketched(docs: DataFrame) -> DataFrame:
    """Add ``sketch`` to rows with a column t; empty for texts without words."""

    @F.pandas_udf("array<long>")
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts, out = [t for t in batch], []
            for i, j in chunks(texts):
                w = Words(texts[i:j], BLANKS)
                grams, begin = labelled_grams(w.hashes(), w.first)
                s = sketches(grams, begin).view(np.int64)
                out += [row if b > a else row[:0] for row, a, b in zip(s, begin, begin[1:])]
            yield pd.Series(out, dtype=object)

    return docs.withColumn("sketch", sketch("t"))


def _words_of(texts: DataFrame) -> DataFrame:
    """id and words (4 bytes of each word's hash) of rows id, t."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, t = batch.column(0), batch.column(1).to_pylist()
            for i, j in chunks(t):
                w = Words(t[i:j], BLANKS)
                h = (w.hashes() >> U64(32)).astype(np.uint32)
                raw = [h[a:b].tobytes() for a, b in zip(w.first, w.first[1:])]
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(raw, pa.binary())], ["id", "words"])

    return texts.select("id", "t").mapInArrow(run, "id long, words binary")


def members(sketched: DataFrame, scratch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """k, s, id of the texts (rows id, sketch) that share the sketch s of number k with another text."""
    by = sketched.select("id", F.posexplode("sketch").alias("k", "s"))
    groups = scratch(by.groupBy("k", "s").count().where("count > 1").select("k", "s"))
    return scratch(by.join(groups, ["k", "s"]).select("k", "s", "id"))


def settled(shared: DataFrame, found: DataFrame | None, scratch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """k, s, id, root of the texts of groups that hold several classes of the links found so far, with
    ``n``, the size of the group."""
    if found is None:
        rows = shared.withColumn("root", F.col("id"))
    else:
        rows = shared.join(components(found, scratch), "id", "left").select("k", "s", "id", F.coalesce("root", "id").alias("root"))
        rows = scratch(rows)
    sizes = rows.groupBy("k", "s").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
    return scratch(rows.join(sizes.where("low < high").select("k", "s", "n"), ["k", "s"]))


def stars(rows: DataFrame) -> DataFrame:
    """id, rep and their rank: each text with the representative of each of its groups, where no chain of
    links joins them. A representative has the smallest hash of its group, so groups that
    share texts share it, and their pairs are few."""
    drawn = F.struct(F.xxhash64("id", F.lit(1)).alias("rank"), F.col("id").alias("rep"), F.col("root").alias("rep_root"))
    reps = rows.groupBy("k", "s").agg(F.min(drawn).alias("m")).select("k", "s", "m.*")
    return rows.join(reps, ["k", "s"]).where("root != rep_root").select("id", "rep", "rank")


def _ordered(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def linked(sketched: DataFrame, words_of: Callable[[DataFrame], DataFrame], threshold: float, scratch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Verified pairs a < b, without repeats, that join every two similar texts of a group by a chain of
    links. ``words_of`` gives the words (id, words) of a table of ids."""
    shared = members(sketched, scratch)
    words = words_of(shared.select("id").distinct())
    rows = settled(shared, None, scratch)
    first = stars(rows.where(f"n > {SMALL_GROUP}")).groupBy("id").agg(F.min(F.struct("rank", "rep")).alias("m"))
    small = rows.where(f"n <= {SMALL_GROUP}").select("k", "s", "id")
    close = small.withColumnRenamed("id", "a").join(small.withColumnRenamed("id", "b"), ["k", "s"]).where("a < b").select("a", "b")
    tried = scratch(first.select("id", "m.rep").select(*_ordered("id", "rep")).unionByName(close).distinct())
    found = scratch(verified(tried, words, threshold))
    rows = settled(shared, found, scratch).where(f"n > {SMALL_GROUP}")
    pairs = scratch(stars(rows).select(*_ordered("id", "rep")).distinct().join(tried, ["a", "b"], "left_anti"))
    found = scratch(found.unionByName(verified(pairs, words, threshold)))
    rows = settled(shared, found, scratch).where(f"n > {SMALL_GROUP}")
    facts = words.join(sketched.select("id", "sketch"), "id")
    return scratch(found.unionByName(apart(rows, facts, threshold)).distinct())


def _bigrams(words: np.ndarray) -> np.ndarray:
    return (words[:-1].astype(U64) << U64(32)) | words[1:].astype(U64)


class Tile:
    """Texts of a tile, so that one is held against all later ones at once: ``shared`` counts word pairs.

    A word pair that a text repeats counts each time, as a gram of its own."""

    def __init__(self, held: list[np.ndarray]):
        grams = [_bigrams(w) for w in held]
        self.first = np.cumsum([0] + [len(g) for g in grams])
        owner = np.repeat(np.arange(len(held)), np.diff(self.first))
        _, code = np.unique(np.concatenate([*grams, np.zeros(0, U64)]), return_inverse=True)
        order = np.lexsort((code, owner))
        c, o = code[order], owner[order]
        fresh = np.concatenate(([True], (c[1:] != c[:-1]) | (o[1:] != o[:-1])))[: len(c)]
        at = np.arange(len(c))
        nth = np.empty(len(c), np.int64)
        nth[order] = at - np.maximum.accumulate(np.where(fresh, at, 0)) if len(c) else at
        _, labels = np.unique(code * (int(nth.max(initial=0)) + 1) + nth, return_inverse=True)
        self.labels = labels.astype(np.int32)
        self.mark = np.zeros(int(labels.max(initial=-1)) + 1, np.int8)

    def shared(self, i: int) -> np.ndarray:
        """Word pairs that text ``i`` shares with each text after it."""
        own = self.labels[self.first[i] : self.first[i + 1]]
        self.mark[own] = 1
        hits = np.concatenate(([0], np.cumsum(self.mark[self.labels[self.first[i + 1] :]], dtype=np.int64)))
        self.mark[own] = 0
        ends = self.first[i + 1 :] - self.first[i + 1]
        return hits[ends[1:]] - hits[ends[:-1]]


def apart(rows: DataFrame, words: DataFrame, threshold: float) -> DataFrame:
    """Verified pairs a < b that join the texts of a group (``settled`` rows) where no chain does yet.

    A group is dealt to tiles; a task takes the words and sketches (``words``: id, words, sketch) of two tiles at most
    and compares their texts there, so neither pairs nor a pair's words are written. Texts that share
    several sketches are compared in the group of the first."""
    sizes = rows.join(words.selectExpr("id", "length(words) AS bytes"), "id").groupBy("k", "s").agg(
        F.expr(f"CAST(greatest(ceil(count(*) / {TILE}), ceil(sum(bytes) / {TILE_BYTES})) AS INT) AS tiles")
    )
    tiled = rows.join(sizes, ["k", "s"]).selectExpr(
        "k", "s", "id", "root", "CAST(pmod(xxhash64(id), tiles) AS INT) AS own", "explode(sequence(0, tiles - 1)) AS other"
    )
    dealt = tiled.join(words, "id").selectExpr(
        "k", "s", "least(own, other) AS p", "greatest(own, other) AS q", "own", "id", "root", "words", "slice(sketch, 1, k) AS earlier"
    )

    def compare(tile: pd.DataFrame) -> pd.DataFrame:
        tile = tile.sort_values("id")
        ids, own = (tile[c].to_numpy() for c in ("id", "own"))
        root = tile["root"].to_numpy().copy()
        out: list[tuple[int, int]] = []
        if (root == root[0]).all():
            return pd.DataFrame(out, columns=["a", "b"], dtype="int64")
        held = [np.frombuffer(w, np.uint32) for w in tile["words"]]
        size = np.array([len(w) for w in held])
        earlier = np.array(tile["earlier"].tolist(), np.int64).reshape(len(held), -1)
        grams, cross = Tile(held), tile["p"].iloc[0] != tile["q"].iloc[0]
        for i in range(len(ids) - 1):
            longer = np.maximum(size[i + 1 :], size[i])
            limit = (longer * (1 - threshold) + 1e-9).astype(np.int64)
            may = (root[i + 1 :] != root[i]) & (np.abs(size[i + 1 :] - size[i]) <= limit)
            if cross:
                may &= own[i + 1 :] != own[i]
            if may.any():
                may &= ~(earlier[i + 1 :] == earlier[i]).any(axis=1)
                may &= grams.shared(i) >= longer - 1 - 2 * limit
            for j in np.flatnonzero(may) + i + 1:
                if root[j] != root[i] and similar(held[i], held[j], threshold):
                    out.append((ids[i], ids[j]))
                    root[root == root[j]] = root[i]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return dealt.groupBy("k", "s", "p", "q").applyInPandas(compare, "a long, b long")


def verified(pairs: DataFrame, words: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose words (rows id, words) align within the threshold."""
    left = pairs.join(words.select(F.col("id").alias("a"), F.col("words").alias("wa")), "a")
    both = left.join(words.select(F.col("id").alias("b"), F.col("words").alias("wb")), "b")

    @F.pandas_udf("boolean")
    def verify(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([similar(np.frombuffer(p, np.uint32), np.frombuffer(q, np.uint32), threshold) for p, q in zip(x, y)], dtype=bool)

    return both.where(verify("wa", "wb")).select("a", "b")


def classes(docs: DataFrame, scratch: Callable[[DataFrame], DataFrame], key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key, class_id, copies (rows with the same text), n_links (verified links of the text) and text_hash of every row."""
    rows = docs.select(
        F.col(key).alias("_key"), F.xxhash64(F.col(key)).alias("_k"), F.xxhash64(F.col(text)).alias("_h1"),
        F.xxhash64(F.lit(1), F.col(text)).alias("_h2"), F.col(text).alias("t"),
    )
    slim = scratch(_sketched(rows).select("_key", "_k", "_h1", "_h2", F.col("t").isNull().alias("_null"), "sketch"))
    # The row with the smallest id stands for equal texts; a null id only where there is no other.
    groups = slim.where("NOT _null").groupBy("_h1", "_h2").agg(
        F.min(F.struct(F.col("_key").isNull().alias("none"), "_key", "_k", "sketch")).alias("m"), F.count("*").alias("copies")
    )
    groups = scratch(groups.select(F.xxhash64("_h1", "_h2").alias("id"), "_h1", "_h2", "copies", F.col("m._key").alias("first"), F.col("m._k").alias("_k"), F.col("m.sketch").alias("sketch")))

    def words_of(ids: DataFrame) -> DataFrame:
        needed = ids.join(groups.select("id", "_h1", "_h2", "_k"), "id")
        texts = rows.select("_h1", "_h2", "_k", "t").join(needed, ["_h1", "_h2", "_k"])
        return scratch(_words_of(texts).dropDuplicates(["id"]))

    found = linked(groups.select("id", "sketch"), words_of, threshold, scratch)
    roots = components(found, scratch)
    degree = found.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))
    named = scratch(groups.drop("sketch").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")).join(degree, "id", "left"))
    least = scratch(named.groupBy("root").agg(F.min("first").alias("class_id")))
    named = scratch(named.join(least, "root").select("_h1", "_h2", "class_id", "copies", "n_links"))
    return slim.join(named, ["_h1", "_h2"], "left").select(
        F.col("_key").alias(key),
        F.when(F.col("_null"), F.col("_key")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("copies", F.lit(1)).alias("copies"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.col("_h1").alias("text_hash"),
    )
