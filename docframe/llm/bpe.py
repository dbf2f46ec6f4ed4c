"""Byte-level BPE through a table of distinct words.

Texts are split into pretokens in Spark tasks and counted; the frequent ones (a
bounded number, chosen by exact counts over all texts) are encoded once into a table
of words and ids that every task receives. Each text takes the ids of its words by
position. Words outside the bounded table are encoded once per batch, so the result
does not depend on the bound. Decoding joins ids with the table of pieces, of the
vocabulary's size.

Defined results: null and empty texts have no ids and decode to the empty text.
Rows are handled one by one: repeated rows repeat, extra columns are passed on, an
empty table stays empty. Added tokens written in a text are recognised, as the
tokenizers library does.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.llm.token_counts import byte_letters
from docframe.llm.words import chunks, slices

TABLE_WORDS = 1 << 18  # words in the shared table at most
TABLE_BYTES = 64  # longer words are not in the table
OTHER_WORDS = 1 << 17  # words outside the table that a task keeps from batch to batch
FLUSH_WORDS = 1 << 17
BATCH_BYTES = 1 << 20
SLICE_ROWS = 512

# The pretoken pattern of byte-level BPE and the blanks it means by \s.
_BLANK = r"\t-\r \x85\xa0  -     　"
_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_BLANK}\p{{L}}\p{{N}}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"
# Scripts whose letters and digits do not depend on the Unicode version; other texts are
# split by the tokenizers library itself.
_SETTLED = r"[^\x00-՗ -⁯　-ヿ一-龥]"


def _splitter(tokenizer_json: str):
    """Function from a text to its pretokens; added tokens are pretokens of their own."""
    import regex
    from tokenizers import Tokenizer

    added = sorted((t["content"] for t in json.loads(tokenizer_json)["added_tokens"]), key=len, reverse=True)
    pieces, unsettled = regex.compile(_PATTERN).findall, regex.compile(_SETTLED).search
    library = Tokenizer.from_str(tokenizer_json).pre_tokenizer

    def find(text: str) -> list[str]:
        if unsettled(text):
            return [text[a:b] for _, (a, b) in library.pre_tokenize_str(text)]
        return pieces(text)

    if not added:
        return find
    cut = regex.compile("(" + "|".join(map(regex.escape, added)) + ")").split

    def split(text: str) -> list[str]:
        if not any(a in text for a in added):
            return find(text)
        out: list[str] = []
        for i, part in enumerate(cut(text)):
            out += [part] if i % 2 else find(part)
        return out

    return split


def _encoder(tokenizer_json: str):
    """Function from words to their ids as little-endian bytes."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(tokenizer_json)
    tok.no_truncation()
    tok.no_padding()
    batch = getattr(tok, "encode_batch_fast", tok.encode_batch)
    return lambda words: [np.array(e.ids, "<u4").tobytes() for e in batch(words, add_special_tokens=False)]


def word_table(docs: DataFrame, tokenizer_json: str, text: str = "text") -> DataFrame:
    """Every distinct pretoken of the texts with its number of occurrences: word, n."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = _splitter(shared.value)
        found: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])
            found.clear()
            return out

        for batch in slices(batches):
            for t in batch.column(0).to_pylist():
                found.update(split(t or ""))
                if len(found) > FLUSH_WORDS:
                    yield flush()
        yield flush()

    parts = docs.select(F.col(text).alias("t")).mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(words: DataFrame, limit: int = TABLE_WORDS) -> DataFrame:
    """The most frequent words, at most ``limit``: all words above a count that a
    histogram of the counts (a few hundred rows) shows to be exceeded often enough."""
    short = words.where(F.octet_length("word") <= TABLE_BYTES).withColumn("level", F.floor(F.log2("n") * 8))
    kept = short.where("n > 1")
    total, least = 0, math.inf
    for r in kept.groupBy("level").count().orderBy(F.desc("level")).collect():
        total += r["count"]
        if total > limit:
            break
        least = r.level
    return kept.where(F.lit(False) if least == math.inf else F.col("level") >= least).select("word")


def encoded_words(words: DataFrame, tokenizer_json: str) -> DataFrame:
    """word, ids (little-endian bytes) of a table of words, encoded where they lie."""
    shared = words.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.column(0).slice(i, SLICE_ROWS)
                yield pa.RecordBatch.from_arrays([part, pa.array(encoder(part.to_pylist()), pa.binary())], ["word", "ids"])

    return words.mapInArrow(run, "word string, ids binary")


def _known(raw: bytes) -> dict[str, bytes]:
    """Words and ids of a table as a dictionary, read in slices; a task holds one and lets it go."""
    found: dict[str, bytes] = {}
    for batch in pa.ipc.open_stream(raw):
        for i in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(i, SLICE_ROWS)
            found.update(zip(part.column(0).to_pylist(), part.column(1).to_pylist()))
    return found


def encode(
    docs: DataFrame, tokenizer_json: str, text: str = "text", table_words: int = TABLE_WORDS, scratch=None, digested: bool = False
) -> DataFrame:
    """Add ``token_ids``. ``scratch`` stores the word counts once, if given. With ``digested``
    the columns of ``digests`` follow, made where the ids are: by themselves they take a second
    Python process beside each task's first, and every id moves there."""
    words = word_table(docs, tokenizer_json, text)
    frequent = frequent_words(scratch(words) if scratch else words, table_words)
    # A bounded table; it reaches the tasks as Arrow columns and is turned into a dictionary there.
    table = encoded_words(frequent, tokenizer_json).toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    shared = docs.sparkSession.sparkContext.broadcast((tokenizer_json, sink.getvalue().to_pybytes()))
    del table, sink

    pieces = docs.sparkSession.sparkContext.broadcast(piece_table(tokenizer_json)) if digested else None

    def coded(batches: Iterator[pd.Series]) -> Iterator[list[np.ndarray]]:
        code, raw = shared.value
        known, others = _known(raw), []
        split, encoder = _splitter(code), _encoder(code)
        for batch in batches:
            texts = [t or "" for t in batch]
            del batch
            for i, j in chunks(texts, BATCH_BYTES):
                parts = [split(t) for t in texts[i:j]]
                rest = list(set().union(*parts).difference(known))
                known.update(zip(rest, encoder(rest)))
                others += rest
                yield [np.frombuffer(b"".join(map(known.__getitem__, p)), "<i4") for p in parts]
                if len(others) > OTHER_WORDS:
                    for w in others:
                        del known[w]
                    others = []

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in coded(batches):
            yield pd.Series(part, dtype=object)

    @F.pandas_udf("token_ids array<int>, ids_sha256 string, decoded_sha256 string")
    def ids_and_digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        piece = pieces.value.__getitem__
        for part in coded(batches):
            digest = [_digest(x, piece) for x in part]
            yield pd.DataFrame({"token_ids": pd.Series(part, dtype=object), "ids_sha256": [a for a, _ in digest], "decoded_sha256": [b for _, b in digest]})

    if not digested:
        return docs.select(*[docs[f"`{c}`"] for c in docs.columns if c != "token_ids"], ids(F.col(text)).alias("token_ids"))
    own = ["token_ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    out = docs.select(*[docs[f"`{c}`"] for c in docs.columns if c not in own], ids_and_digests(F.col(text)).alias("_d"))
    counted = F.size("_d.token_ids").cast("long").alias("n_tokens")
    return out.select("*", "_d.token_ids", counted, "_d.ids_sha256", "_d.decoded_sha256").drop("_d")


def piece_table(tokenizer_json: str) -> list[bytes]:
    """Bytes of each id."""
    content, back = json.loads(tokenizer_json), byte_letters()
    vocab = {**content["model"]["vocab"], **{t["content"]: t["id"] for t in content["added_tokens"]}}
    out = [b""] * (max(vocab.values(), default=-1) + 1)
    for piece, i in vocab.items():
        out[i] = bytes(back[c] for c in piece) if all(c in back for c in piece) else piece.encode()
    return out


def decode(docs: DataFrame, tokenizer_json: str, ids: str = "token_ids") -> DataFrame:
    """Add ``decoded``, the text of the ids; bytes that are no UTF-8 become U+FFFD."""
    shared = docs.sparkSession.sparkContext.broadcast(piece_table(tokenizer_json))

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        piece = shared.value.__getitem__
        for batch in batches:
            yield pd.Series([b"".join(map(piece, x.tolist())).decode("utf-8", "replace") if x is not None else "" for x in batch])

    return docs.select(*[docs[f"`{c}`"] for c in docs.columns if c != "decoded"], text_of(F.col(ids)).alias("decoded"))


def _digest(ids: np.ndarray, piece) -> tuple[str, str]:
    """SHA-256 of ids as little-endian 32-bit numbers, and of the text they decode to."""
    text = b"".join(map(piece, ids.tolist())).decode("utf-8", "replace")
    return sha256(ids.astype("<u4").tobytes()).hexdigest(), sha256(text.encode()).hexdigest()


def digests(encoded: DataFrame, tokenizer_json: str, ids: str = "token_ids") -> DataFrame:
    """Add ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``: of the ids as little-endian
    32-bit numbers and of the text they decode to."""
    shared = encoded.sparkSession.sparkContext.broadcast(piece_table(tokenizer_json))

    @F.pandas_udf("ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        piece = shared.value.__getitem__
        for batch in batches:
            for i in range(0, len(batch), SLICE_ROWS):
                rows = [_digest(x, piece) for x in batch.iloc[i : i + SLICE_ROWS]]
                yield pd.DataFrame(rows, columns=["ids_sha256", "decoded_sha256"])

    own = ["n_tokens", "ids_sha256", "decoded_sha256"]
    out = encoded.select(*[F.col(f"`{c}`") for c in encoded.columns if c not in own], F.size(ids).cast("long").alias("n_tokens"), digest(F.col(ids)).alias("_d"))
    return out.select("*", "_d.ids_sha256", "_d.decoded_sha256").drop("_d")
