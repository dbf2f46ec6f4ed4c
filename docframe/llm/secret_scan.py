"""Secrets in texts: fixed patterns, and random strings found by token efficiency.

A byte-pair vocabulary has long pieces for what people write and only short ones for
random letters, so few characters per token expose a key or a password. Candidates are
runs of key letters; known digests (hex of usual digest lengths, UUIDs) and identifiers
(numbers, words joined by separators or humps) are left out first, as their shape
already says what they are. Spans of the fixed patterns are never left out.

Spans are ``kind:start:end`` in code points, end exclusive, ordered by start, then kind.
Defined results: null and empty texts have no spans. Rows are handled one by one:
repeated rows repeat, extra columns are passed on (one named like an output column is
replaced), an empty table stays empty. Whole texts are read; a long candidate is
tokenised in pieces of ``PIECE_CHARS`` so that its cost stays in proportion to its length.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "random")
MIN_CHARS = 20  # shorter runs are too short for a ratio
MAX_RATIO = 1.8  # characters per token below which a run counts as random
PIECE_CHARS = 512

# The base patterns with the least length of what they must hold.
# Runs are taken whole first where a shorter run could hide a later match.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_CHARS = 6
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_ACCESS_CHARS = 20
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{MIN_CHARS},}}={{0,2}}")
# Lengths of usual digests in hex digits (MD5, SHA-1, SHA-2 family).
_DIGEST_CHARS = (32, 40, 56, 64, 96, 128)
_DIGEST = re.compile("|".join(rf"[0-9a-f]{{{n}}}" for n in _DIGEST_CHARS), re.I | re.A)
_UUID = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.I | re.A)
_SEPARATORS = re.compile(r"[+/_=-]+")
# A section of an identifier: a number, or a word with a short number after it.
_SECTION = re.compile(r"[0-9]+|([A-Za-z]+)[0-9]{0,4}")
_HUMPS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
# Words of an identifier have this many letters on average.
PART_LETTERS = 3.0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping per kind."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= _ASSIGN_CHARS]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= _ACCESS_CHARS]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def is_known(run: str) -> bool:
    """Whether a run is a digest, a UUID or an identifier by its shape."""
    if _DIGEST.fullmatch(run) or _UUID.fullmatch(run):
        return True
    words = []
    for section in filter(None, _SEPARATORS.split(run)):
        m = _SECTION.fullmatch(section)
        if not m:
            return False
        words += _HUMPS.findall(m.group(1) or "")
    if len(words) == 1 and words[0] == run:  # one long word has no shape to judge by
        return False
    return sum(map(len, words)) >= PART_LETTERS * len(words)


def characters_per_token(run: str, count) -> float:
    """Ratio of a run; ``count`` gives the tokens of a short text."""
    return len(run) / sum(count(run[i : i + PIECE_CHARS]) for i in range(0, len(run), PIECE_CHARS))


def random_spans(text: str, count, max_ratio: float, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs outside ``taken`` spans that the vocabulary spells in short pieces."""
    out = []
    at, ends = 0, sorted((s, e) for s, _, e in taken)
    last = 0  # furthest end of a taken span that starts before the run's end
    for m in _RUN.finditer(text):
        while at < len(ends) and ends[at][0] < m.end():
            last = max(last, ends[at][1])
            at += 1
        if last > m.start() or is_known(m.group()):
            continue
        if characters_per_token(m.group(), count) < max_ratio:
            out.append((m.start(), 3, m.end()))
    return out


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def token_counter(ranks: bytes):
    """Function from a short text to its number of tokens under a rank file's content."""
    import tiktoken
    from public_tokenizers import PATTERN

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    coder = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return lambda text: len(coder.encode_ordinary(text))


def scan(docs: DataFrame, ranks: bytes, text: str = "text", max_ratio: float = MAX_RATIO) -> DataFrame:
    """Add ``n_assign, n_access, n_hex, n_random``, ``base_spans`` (the fixed patterns) and
    ``spans`` (all) as text. ``ranks`` is the content of a tiktoken rank file."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    kinds = ["n_assign", "n_access", "n_hex", "n_random"]

    @F.pandas_udf(", ".join(f"{k} long" for k in kinds) + ", base_spans string, spans string")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        count = token_counter(shared.value)
        for batch in batches:
            rows = []
            for t in batch:
                base = base_spans(t) if t else []
                every = sorted(base + random_spans(t, count, max_ratio, base)) if t else []
                n = [sum(k == i for _, k, _ in every) for i in range(len(KINDS))]
                rows.append((*n, _written(base), _written(every)))
            yield pd.DataFrame(rows, columns=[*kinds, "base_spans", "spans"])

    own = [*kinds, "base_spans", "spans"]
    found = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), find(F.col(text)).alias("found"))
    return found.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in own], *[F.col(f"found.{c}") for c in own])


def redact(text: str, spans: str, mark: str = "[REDACTED]") -> str:
    """A text without the spans that ``scan`` wrote for it; overlapping spans become one mark."""
    out, at = [], 0
    for s, e in sorted((int(s), int(e)) for _, s, e in (x.split(":") for x in spans.split(",") if x)):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]
