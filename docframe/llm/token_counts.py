"""Greedy longest-match token counts by a linear automaton.

A trie holds the vocabulary. Each node has a failure link and the number of tokens
popped on the way, so that a word is counted in one pass over its bytes without
building a piece. All distinct words of a chunk advance together.

A word is a run of bytes other than ASCII blanks; it is matched with a leading blank,
as word-initial pieces of byte-level vocabularies carry one. The vocabulary must hold
every single byte. Null and empty texts count 0 words and 0 tokens. Rows are handled
one by one: repeated rows repeat, extra columns are passed on, an empty table stays
empty. A very long word costs time in proportion to its length.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.llm.words import BLANKS, Words, chunks

LONG_WORD = 48  # bytes; longer words are walked one by one


@dataclass
class Automaton:
    """Arrays by node; node 0 is the root. ``key`` is node * 256 + byte, sorted."""

    key: np.ndarray
    child: np.ndarray
    fail: np.ndarray
    popped: np.ndarray
    rest: np.ndarray


def byte_pieces(tokenizer_json: str) -> list[bytes]:
    """Pieces of a byte-level vocabulary file in the order of their ids, as bytes."""
    vocab = json.loads(tokenizer_json)["model"]["vocab"]
    back = byte_letters()
    return [bytes(back[c] for c in p) for p in sorted(vocab, key=vocab.get)]


def byte_letters() -> dict[str, int]:
    """Byte of each letter by which byte-level vocabularies write it: visible Latin-1
    characters stand for themselves, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(others)}


def build(pieces: list[bytes]) -> Automaton:
    """Trie with failure links, by breadth-first search."""
    missing = {bytes([b]) for b in range(256)} - set(pieces)
    if missing:
        raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
    step: list[dict[int, int]] = [{}]
    token = [False]
    for p in pieces:
        node = 0
        for b in p:
            nxt = step[node].get(b)
            if nxt is None:
                nxt = step[node][b] = len(step)
                step.append({})
                token.append(False)
            node = nxt
        token[node] = bool(p)
    fail, popped, rest = [0] * len(step), [0] * len(step), [0] * len(step)
    level = [(0, b, c) for b, c in step[0].items()]
    while level:
        below = []
        for parent, b, node in level:
            if token[node]:
                fail[node], popped[node] = 0, 1
            else:
                at, n = fail[parent], popped[parent]
                while b not in step[at]:
                    n += popped[at]
                    at = fail[at]
                fail[node], popped[node] = step[at][b], n
            rest[node] = popped[node] + rest[fail[node]]
            below.extend((node, x, c) for x, c in step[node].items())
        level = below
    edges = sorted((n << 8 | b, c) for n, d in enumerate(step) for b, c in d.items())
    return Automaton(*(np.array(x, np.int64) for x in ([e[0] for e in edges], [e[1] for e in edges], fail, popped, rest)))


def _step(a: Automaton, node: np.ndarray, byte: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Advance every word by one byte; the root has an edge for every byte."""
    out = np.zeros(len(node), np.int64)
    todo = np.arange(len(node))
    while len(todo):
        want = node[todo] << 8 | byte[todo]
        at = np.searchsorted(a.key, want)
        at[at == len(a.key)] = 0
        hit = a.key[at] == want
        out[todo[hit]] = a.child[at[hit]]
        todo = todo[~hit]
        count[todo] += a.popped[node[todo]]
        node[todo] = a.fail[node[todo]]
    return out


def word_counts(a: Automaton, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Number of tokens of each word, its leading blank included."""
    size = end - start
    count = np.zeros(len(start), np.int64)
    node = np.full(len(start), a.child[np.searchsorted(a.key, 0x20)], np.int64)
    order = np.argsort(-size, kind="stable")
    node, count, start, size = node[order], count[order], start[order], size[order]
    live = len(size)
    for i in range(min(LONG_WORD, int(size.max(initial=0)))):
        live = int(np.searchsorted(-size[:live], -i, "left"))
        part = count[:live]
        node[:live] = _step(a, node[:live].copy(), buf[start[:live] + i].astype(np.int64), part)
    edge = dict(zip(a.key.tolist(), a.child.tolist())) if len(size) and size[0] > LONG_WORD else {}
    for w in range(int(np.searchsorted(-size, -LONG_WORD, "left"))):
        at, n = int(node[w]), 0
        for b in buf[start[w] + LONG_WORD : start[w] + size[w]].tolist():
            while (at << 8 | b) not in edge:
                n += int(a.popped[at])
                at = int(a.fail[at])
            at = edge[at << 8 | b]
        node[w] = at
        count[w] += n
    out = np.empty_like(count)
    out[order] = count + a.rest[node]
    return out


def count_texts(a: Automaton, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Words and tokens of each text."""
    w = Words(texts, BLANKS)
    if not len(w.start):
        zero = np.zeros(len(texts), np.int64)
        return zero, zero
    # Words are told apart by 128 bits.
    both = np.empty(len(w.start), [("a", "<u8"), ("b", "<u8")])
    both["a"], both["b"] = w.hashes(), w.hashes(1)
    order = np.lexsort((both["b"], both["a"]))
    fresh = np.append(True, both[order][1:] != both[order][:-1])
    one, back = order[fresh], np.empty(len(order), np.int64)
    back[order] = np.cumsum(fresh) - 1
    total = np.concatenate(([0], np.cumsum(word_counts(a, w.buf, w.start[one], w.end[one])[back])))
    return np.diff(w.first), total[w.first[1:]] - total[w.first[:-1]]


def count_tokens(docs: DataFrame, pieces: list[bytes], text: str = "text") -> DataFrame:
    """Add ``n_words`` and ``n_tokens``."""
    shared = docs.sparkSession.sparkContext.broadcast(build(pieces))

    @F.pandas_udf("n_words long, n_tokens long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [None if t is None else t for t in batch]
            parts = [count_texts(shared.value, texts[i:j]) for i, j in chunks(texts, 4 << 20)]
            both = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in (0, 1)]
            yield pd.DataFrame({"n_words": both[0], "n_tokens": both[1]})

    names = ["n_words", "n_tokens"]
    out = docs.withColumn("_counts", count(F.col(text)))
    return out.select(*[docs[f"`{c}`"] for c in docs.columns if c not in names], *[F.col(f"_counts.{c}") for c in names])
