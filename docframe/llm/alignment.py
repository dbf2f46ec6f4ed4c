"""Alignment of two tokenizers over the bytes of each text, by merge-path partitioning.

Both tokenizers cut the same bytes (a blank and the text). Merging the ends of A's and
B's tokens gives the overlaps: each merged end closes one stretch that lies in one token
of A and one of B; where both end, a group of tokens closes and the two last tokens are
linked. The merge is cut by diagonals of equal work: a binary search finds how many ends
of each side come before a diagonal, so every piece is merged alone, and only the piece's
last end has to be compared with the next piece's first to stitch a group.

Spark deals texts to tasks. A task encodes each distinct stretch between single blanks
once (neither vocabulary has a piece that crosses such a blank), gathers the tokens of a
bounded chunk of texts, merges them and returns per text its counts, the digest of its
groups, and its distinct linked id pairs with their numbers. Links of the whole corpus
are then counted by Spark. Counts go back to the texts by joins: the pairs that hold at
least one ``HOT``-th of all links (at most ``HOT`` of them, by arithmetic) are broadcast,
all others, none of them large, meet by a shuffle.

Defined results. Null and empty texts, and texts whose tokens of A or B do not spell the
same bytes (B writes blanks as U+2581, so a text with that letter differs), have no
tokens: zeros and ''. Rows are handled one by one: repeated rows repeat and each counts;
null ids are kept; extra columns but the text are passed on (one named like an output
column is replaced); an empty table stays empty. Whole texts are read; arrays of a task are bounded
by a chunk of ``CHUNK_CHARS`` or one longer text.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.llm.token_counts import byte_letters

CHUNK_CHARS = 1 << 20
PIECE_ENDS = 1 << 16  # ends merged in one piece
CACHE_WORDS = 400_000  # stretches kept with their tokens in a task
CACHE_CHARS = 48  # longer ones are not kept
HOT = 1 << 16
SLICE_ROWS = 512
ID_BITS = 20  # ids of a vocabulary are below 2**20
OUT = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

# A stretch begins at a single blank between two letters that no tokenizer takes for a blank.
_CUT = re.compile(r"(?<=\S)(?= \S)")
_OTHER_BLANKS = re.compile(r"\s | \s|^ | $")


def stretches(text: str) -> list[str]:
    """Stretches of a blank and the text, each without its first blank."""
    if not _OTHER_BLANKS.search(text):
        return text.split(" ")
    return [s[1:] for s in _CUT.split(" " + text)]


@dataclass(frozen=True)
class Vocabularies:
    """A: content of a byte-level vocabulary file; B: a serialised sentencepiece model."""

    a_json: str
    b_model: bytes


class Encoder:
    """Tokens of stretches as ids and byte lengths, for both vocabularies."""

    def __init__(self, files: Vocabularies):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(files.a_json)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.batch = getattr(self.a, "encode_batch_fast", self.a.encode_batch)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=files.b_model)
        letters = byte_letters()
        vocab = json.loads(files.a_json)["model"]["vocab"]
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            self.a_bytes[i] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
        self.b_bytes = [self._b_piece(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        if max(len(self.a_bytes), len(self.b_bytes)) > 1 << ID_BITS:
            raise ValueError(f"vocabularies have at most 2**{ID_BITS} ids")
        if any("▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(len(self.b_bytes))):
            raise ValueError("a piece of B crosses a blank; texts cannot be cut at blanks")
        self.a_sizes = np.array([len(p) for p in self.a_bytes], np.int32)
        self.b_sizes = np.array([len(p) for p in self.b_bytes], np.int32)

    @staticmethod
    def _b_piece(piece: str) -> bytes:
        if re.fullmatch("<0x[0-9A-F]{2}>", piece):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def encode(self, words: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[int]]:
        """For A and B all ids of the stretches (given without their first blank) with the number
        of each, and the stretches that the two do not spell alike; those have no ids."""
        spaced = [" " + w for w in words]
        ids = [[e.ids for e in self.batch(spaced, add_special_tokens=False)], self.b.encode(words, num_threads=1)]
        sides = [(np.fromiter(chain.from_iterable(x), np.int32), np.fromiter(map(len, x), np.int64, len(x))) for x in ids]
        pieces = (self.a_bytes.__getitem__, self.b_bytes.__getitem__)
        raw = [w.encode() for w in spaced]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        spelled = [np.diff(np.concatenate(([0], np.cumsum(sizes[flat])))[np.concatenate(([0], np.cumsum(n)))]) for (flat, n), sizes in zip(sides, (self.a_sizes, self.b_sizes))]
        whole = b"".join(raw)
        if all((x == size).all() for x in spelled) and all(b"".join(map(piece, flat.tolist())) == whole for piece, (flat, _) in zip(pieces, sides)):
            return sides, []
        bad = [i for i, w in enumerate(raw) if any(b"".join(map(piece, x[i])) != w for piece, x in zip(pieces, ids))]
        for x in ids:
            for i in bad:
                x[i] = []
        return [(np.fromiter(chain.from_iterable(x), np.int32), np.fromiter(map(len, x), np.int64, len(x))) for x in ids], bad


class Table:
    """Tokens of the stretches met so far as flat arrays. Number 0 stands for no tokens;
    numbers in ``bad`` are stretches that the two sides spell differently."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder
        self.reset()

    def reset(self) -> None:
        self.number: dict[str, int] = {}
        self.ids = [np.zeros(0, np.int32), np.zeros(0, np.int32)]
        self.size = [np.zeros(1, np.int64), np.zeros(1, np.int64)]
        self.bad: set[int] = set()

    def _add(self, words: list[str]) -> None:
        at = len(self.size[0])
        sides, bad = self.encoder.encode(words)
        self.bad.update(at + i for i in bad)
        for side, (flat, n) in enumerate(sides):
            self.ids[side] = np.append(self.ids[side], flat)
            self.size[side] = np.append(self.size[side], n)

    def tokens(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Number of each stretch, which numbers are bad, and for both sides all ids with the sizes of the numbers."""
        if len(self.number) > CACHE_WORDS:
            self.reset()
        fresh = set(words).difference(self.number)
        kept = [w for w in fresh if len(w) <= CACHE_CHARS]
        if kept:
            self.number.update(zip(kept, range(len(self.size[0]), len(self.size[0]) + len(kept))))
            self._add(kept)
        if len(kept) == len(fresh):
            return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)), self._bad(), list(zip(self.ids, self.size))
        before = [len(x) for x in (*self.ids, *self.size)]
        long = list(fresh.difference(kept))
        number = self.number | dict(zip(long, range(before[2], before[2] + len(long))))
        self._add(long)
        out = np.fromiter(map(number.__getitem__, words), np.int64, len(words)), self._bad(), list(zip(self.ids, self.size))
        # Long stretches stay for this chunk only.
        self.ids = [x[:n] for x, n in zip(self.ids, before[:2])]
        self.size = [x[:n] for x, n in zip(self.size, before[2:])]
        self.bad = {i for i in self.bad if i < before[2]}
        return out

    def _bad(self) -> np.ndarray:
        out = np.zeros(len(self.size[0]), bool)
        out[list(self.bad)] = True
        return out


def gather(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Concatenation of the slices ``flat[first : first + size]``."""
    total = np.cumsum(size)
    if not len(total):
        return flat[:0]
    return flat[np.arange(total[-1]) + np.repeat(first - total + size, size)]


def diagonals(a: np.ndarray, b: np.ndarray, step: int = PIECE_ENDS) -> np.ndarray:
    """How many ends of ``a`` come before each diagonal of the merge of two sorted arrays
    (an end of both sides comes from ``a`` first), all by one binary search."""
    at = np.append(np.arange(0, len(a) + len(b), step), len(a) + len(b))
    low, high = np.maximum(at - len(b), 0), np.minimum(at, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        # a[middle] belongs before the diagonal if it is not greater than the last b taken without it
        i, j = middle[open_], (at - middle)[open_] - 1
        before = a[i] <= b[j]
        low[open_] = np.where(before, i + 1, low[open_])
        high[open_] = np.where(before, high[open_], i)
    return low


def merge_piece(a: np.ndarray, b: np.ndarray, a0: int, a1: int, b0: int, b1: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlaps closed by the ends ``a[a0:a1]`` and ``b[b0:b1]``: token of A, token of B, and
    whether both end there. An end of A that B shares is closed with B's."""
    left, right = a[a0:a1], b[b0:b1]
    in_b = np.searchsorted(right, left)  # ends of B in the piece before each end of A
    in_a = np.searchsorted(left, right, "right")
    shared = in_b < len(right)
    shared[shared] = right[in_b[shared]] == left[shared]
    both = np.zeros(len(right), bool)
    both[in_b[shared]] = True
    own = np.flatnonzero(~shared)
    x = np.concatenate((a0 + own, a0 + in_a - both))
    y = np.concatenate((b0 + in_b[own], np.arange(b0, b1)))
    order = np.argsort(x + y, kind="stable")
    return x[order], y[order], np.concatenate((np.zeros(len(own), bool), both))[order]


def overlaps(a: np.ndarray, b: np.ndarray, step: int = PIECE_ENDS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Overlaps of all tokens, piece by piece. Where a shared end is cut by a diagonal (A's
    is the last of one piece, B's the first of the next) the earlier piece's overlap is
    taken back, as the later one closes it as a shared end."""
    cut_a = diagonals(a, b, step)
    cut_b = np.append(np.arange(0, len(a) + len(b), step), len(a) + len(b)) - cut_a
    for k in range(len(cut_a) - 1):
        a0, a1, b0, b1 = int(cut_a[k]), int(cut_a[k + 1]), int(cut_b[k]), int(cut_b[k + 1])
        x, y, both = merge_piece(a, b, a0, a1, b0, b1)
        if a0 and b0 < b1 and a[a0 - 1] == b[b0]:  # stitch with the piece before
            x[0], both[0] = a0 - 1, True
        if a1 > a0 and b1 < len(b) and a[a1 - 1] == b[b1]:
            x, y, both = x[:-1], y[:-1], both[:-1]
        yield x, y, both


class Aligner:
    """Aligns chunks of texts with a table of stretches."""

    def __init__(self, files: Vocabularies):
        self.encoder = Encoder(files)
        self.table = Table(self.encoder)
        n = max(len(self.encoder.a_bytes), len(self.encoder.b_bytes))
        self.names = np.array([[f"{i}{sign}" for i in range(n)] for sign in ",|;"], object)

    def tokens(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids, byte ends and first token of each text, for A and B; bad texts have none."""
        words: list[str] = []
        first = [0]
        for t in texts:
            if t:
                words += stretches(t)
            first.append(len(words))
        at, bad, sides = self.table.tokens(words)
        where = np.array(first)
        wrong = np.concatenate(([0], np.cumsum(bad[at])))
        at[np.repeat(wrong[where[1:]] > wrong[where[:-1]], np.diff(where))] = 0
        out = []
        for (flat, size), letters in zip(sides, (self.encoder.a_sizes, self.encoder.b_sizes)):
            ids = gather(flat, (np.cumsum(size) - size)[at], size[at])
            count = np.concatenate(([0], np.cumsum(size[at])))
            out.append((ids, np.cumsum(letters[ids], dtype=np.int64), count[where]))
        return out

    def align(self, texts: list[str | None]) -> pa.StructArray:
        """Counts, digest of the groups, and distinct linked pairs of each text."""
        (a, a_end, a_first), (b, b_end, b_first) = self.tokens(texts)
        link_a, link_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for x, y, both in overlaps(a_end, b_end):
            link_a.append(x[both])
            link_b.append(y[both])
        la, lb = np.concatenate(link_a), np.concatenate(link_b)
        n_links = np.diff(np.searchsorted(la, a_first))
        # Written order: all of A's tokens of a group, then all of B's.
        group_a = np.repeat(np.arange(len(la)), np.diff(np.concatenate(([-1], la))))
        group_b = np.repeat(np.arange(len(lb)), np.diff(np.concatenate(([-1], lb))))
        before_b, upto_a = np.concatenate(([0], lb + 1)), la + 1
        sign_a, sign_b = np.zeros(len(a), np.int8), np.zeros(len(b), np.int8)
        sign_a[la], sign_b[lb] = 1, 2
        parts = np.empty(len(a) + len(b), object)
        parts[np.arange(len(a)) + before_b[group_a]] = self.names[sign_a, a]
        parts[np.arange(len(b)) + upto_a[group_b]] = self.names[sign_b, b]
        shas = []
        for i in range(len(texts)):
            lo, hi = a_first[i] + b_first[i], a_first[i + 1] + b_first[i + 1]
            shas.append(hashlib.sha256("".join(parts[lo:hi])[:-1].encode()).hexdigest() if hi > lo else "")
        doc = np.repeat(np.arange(len(texts)), n_links)
        keys, n = np.unique((doc << 2 * ID_BITS) | (a[la].astype(np.int64) << ID_BITS) | b[lb], return_counts=True)
        cuts = np.searchsorted(keys >> 2 * ID_BITS, np.arange(len(texts) + 1))
        low = keys & ((1 << 2 * ID_BITS) - 1)
        pairs = pa.StructArray.from_arrays(
            [pa.array((low >> ID_BITS).astype(np.int32)), pa.array((low & ((1 << ID_BITS) - 1)).astype(np.int32)), pa.array(n.astype(np.int32))],
            ["a", "b", "n"],
        )
        fields = {
            "n_a": pa.array(np.diff(a_first)), "n_b": pa.array(np.diff(b_first)), "n_links": pa.array(n_links.astype(np.int64)),
            "groups_sha256": pa.array(shas, pa.string()), "links": pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pairs),
        }
        return pa.StructArray.from_arrays(list(fields.values()), list(fields))


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Slices of about ``CHUNK_CHARS`` letters; a longer text is a slice of its own."""
    at, total = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if total and total + n > CHUNK_CHARS:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(texts):
        yield at, len(texts)


def align(docs: DataFrame, files: Vocabularies, text: str = "text") -> DataFrame:
    """Every row without its text, with ``n_a, n_b, n_links, groups_sha256`` and ``links``: the
    text's distinct linked id pairs with their number."""
    shared = docs.sparkSession.sparkContext.broadcast(files)

    @F.arrow_udf("n_a long, n_b long, n_links long, groups_sha256 string, links array<struct<a:int,b:int,n:int>>")
    def aligned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        aligner = Aligner(shared.value)
        for batch in batches:
            parts = []
            for s in range(0, len(batch), SLICE_ROWS):
                texts = batch.slice(s, SLICE_ROWS).to_pylist()
                parts += [aligner.align(texts[i:j]) for i, j in _chunks(texts)]
            yield pa.concat_arrays(parts) if parts else aligner.align([])

    own = ["n_a", "n_b", "n_links", "groups_sha256", "links"]
    columns = [c for c in docs.columns if c != text]
    found = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("given"), aligned(F.col(f"`{text}`")).alias("found"))
    return found.select(*[F.col(f"given.`{c}`") for c in columns if c not in own], *[F.col(f"found.{c}") for c in own])


def corpus_counts(aligned: DataFrame) -> DataFrame:
    """Links of the whole corpus per id pair: ``a, b, n``."""
    links = aligned.select(F.explode("links").alias("l"))
    return links.groupBy("l.a", "l.b").agg(F.sum(F.col("l.n").cast("long")).alias("n"))


def with_best(pairs: DataFrame) -> DataFrame:
    """Add ``best``: whether the pair's count is the highest of its b, ties included."""
    top = pairs.groupBy("b").agg(F.max("n").alias("top"))
    return pairs.join(top, "b").select("a", "b", "n", (F.col("n") == F.col("top")).alias("best"))


def align_corpus(docs: DataFrame, files: Vocabularies, store: Callable[[DataFrame], DataFrame], text: str = "text") -> DataFrame:
    """Every row without its text, with ``n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``."""
    columns = [c for c in docs.columns if c not in (*OUT, text)]
    given = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in columns]).alias("given"), F.col(f"`{text}`").alias("text"))
    # The stored rows are numbered once; later branches read the same numbers.
    aligned = store(align(given, files).withColumn("row", F.monotonically_increasing_id()))
    counts = store(with_best(store(corpus_counts(aligned))))
    total = counts.agg(F.sum("n")).first()[0] or 0
    key = lambda p: (F.col(f"{p}a").cast("long") * (1 << ID_BITS) + F.col(f"{p}b")).alias("key")
    keyed = counts.select(key(""), "n", "best")
    # At most HOT pairs can hold a HOT-th of all links each.
    hot, rest = (F.broadcast(keyed.where(F.col("n") * HOT >= total)), keyed.where(F.col("n") * HOT < total))
    links = aligned.select("row", F.explode("links").alias("l")).select("row", key("l."), F.col("l.n").alias("times"))
    sums = [F.sum(F.col("times") * F.col("n")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best")]
    parts = links.join(hot, "key").groupBy("row").agg(*sums).unionByName(
        links.join(hot, "key", "left_anti").join(rest, "key").groupBy("row").agg(*sums)
    )
    both = parts.groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return aligned.drop("links").join(both, "row", "left").select(
        *[F.col(f"given.`{c}`") for c in columns], "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links",
        zero("n_best"), zero("count_sum"), "groups_sha256",
    )
