"""Words of many texts at once, and hashes of words and word ranges, in numpy.

Texts are handled as UTF-8 bytes. All separators are ASCII, so byte and character
level agree. A word's hash adds up a mixed value of each byte and its place in the word;
there are two with other constants, each 64 bits. A range of words is a polynomial modulo
2**64 over their hashes, finished by a bijective mix; over both word hashes, with another
base for each, it gives 128 bits. Ranges are short (tens of words).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20  # arrays of 8 bytes a character are made of a chunk
SLICE_ROWS = 512
U64 = np.uint64


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """Table of 256 flags; ``ranges`` hold first and last separator byte."""
    table = np.zeros(256, bool)
    for a, b in ranges:
        table[a : b + 1] = True
    return table


BLANKS = separators((0x09, 0x0D), (0x20, 0x20))
NOT_ALNUM = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finishing step: every bit depends on every other."""
    return _mix_into(x.copy())


def _mix_into(x: np.ndarray) -> np.ndarray:
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_LETTERS = np.random.default_rng(7).integers(1, 1 << 63, (2, 256), dtype=np.uint64)
_PLACES = (U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB))
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base & (2**64 - 1), U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values * _powers(base, len(values))[:-1], out=total[1:])
    back = _powers(pow(base, -1, 2**64), int(starts.max(initial=0)))
    return mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(U64))


class Words:
    """Words of a list of texts: ``start``/``end`` bytes, ``first`` word index of each text (and the total)."""

    def __init__(self, texts: list[str | None], table: np.ndarray, lower: bool = False):
        raw = [(t or "").encode() for t in texts]
        buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        self.buf = LOWER[buf] if lower else buf
        edge = np.diff(np.concatenate(([False], ~table[self.buf], [False])).view(np.int8))
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        begins = np.cumsum([0] + [len(r) + 1 for r in raw])
        self.first = np.searchsorted(self.start, begins)
        self.begins = begins

    def hashes(self, kind: int = 0) -> np.ndarray:
        """Hash of each word; ``kind`` 0 and 1 are independent."""
        size = self.end - self.start
        if not len(size):
            return np.zeros(0, U64)
        first = np.cumsum(size) - size
        if not hasattr(self, "_letters"):
            place = np.arange(int(size.sum()), dtype=np.int32)
            self._letters = self.buf[place + np.repeat((self.start - first).astype(np.int32), size)]
            self._places = (place - np.repeat(first.astype(np.int32), size)).astype(U64)
        values = self._places * _PLACES[kind]
        values += _LETTERS[kind][self._letters]
        return mix(np.add.reduceat(_mix_into(values), first) + size.view(U64))


def ranges(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: int = 0) -> np.ndarray:
    """Hash of the words from ``starts`` up to ``ends``, from their hashes of the same ``kind``."""
    return _range_hash(hashes, starts, ends, _BASES[kind])


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that few texts are Python objects at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(i, SLICE_ROWS)


def chunks(texts: list[str | None], size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Slices of ``texts`` of about ``size`` characters; a longer text is a slice of its own."""
    at, total = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if total and total + n > size:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(texts):
        yield at, len(texts)
