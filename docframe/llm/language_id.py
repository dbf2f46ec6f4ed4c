"""Language identification by compression with per-language dictionaries.

Each language has a raw-content zstandard dictionary made of a bounded sample of
labelled texts. A text is compressed with every dictionary, in blocks that are small
against the dictionary so that long texts cannot learn from themselves; all blocks
count. The language with the fewest bytes wins. A text is rejected when it has no
letter or when the runner-up needs hardly more bytes.

The sample of a dictionary is bounded by parameters and need not grow with the input.
Dictionaries of languages with at least LEAST_BYTES of sample are cut to one size, that
of the smallest among them; a language with less keeps its whole sample and does not
shorten the others.

Defined results: null texts and texts without a letter give ``und``, score 0,
rejected. Without any learned language every text gives ``und``. Ties go to the
language with more learned lines and are rejected. Repeated rows get equal results; an empty
table gives an empty result. Other columns are passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNDEFINED = "und"
SAMPLE_LINES = 600  # distinct lines learned from per language
LINE_BYTES = 2048  # of one sampled line; shorter lines are preferred
SLICES = 64
MAX_LANGUAGES = 256  # 28 MB of dictionaries at most
DICT_BYTES = 112 << 10
LEAST_BYTES = 16 << 10  # of sample, from which a language counts for the common size
BLOCK_BYTES = 4096
LEVEL = 6
MARGIN = 0.005
# Letters in lower case count; runs of other ASCII characters are one blank.
_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

_PREDICTION = "lang_pred string, score double, margin double, rejected boolean"


def normal(text: str) -> bytes:
    return b" ".join(text.lower().encode().translate(_LETTERS).split())


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", sample_lines: int = SAMPLE_LINES) -> dict[str, bytes]:
    """Dictionary per language from ``sample_lines`` distinct lines, chosen by the hash of the line.

    Lines that occur under two languages (boilerplate, quotations) are left out. The
    driver receives at most MAX_LANGUAGES * sample_lines * LINE_BYTES bytes.
    """
    rows = labelled.select(F.col(lang).alias("l"), F.explode(F.split(F.col(text), "\n")).alias("t"))
    rows = rows.where("l IS NOT NULL AND t RLIKE '\\\\p{L}'").withColumn("h", F.xxhash64("t"))
    per_line = rows.groupBy("h").agg(
        F.min("l").alias("l"), F.max("l").alias("l2"), (F.min(F.octet_length("t")) > LINE_BYTES).alias("long")
    )
    best = Window.partitionBy("l").orderBy("long", "h")
    # First within slices of a language, so that no task receives the best lines of every input partition.
    part = Window.partitionBy("l", F.pmod("h", F.lit(SLICES))).orderBy("long", "h")
    sliced = per_line.where("l = l2").withColumn("n", F.row_number().over(part)).where(F.col("n") <= sample_lines)
    picked = sliced.withColumn("n", F.row_number().over(best)).where(F.col("n") <= sample_lines)
    chosen = picked.select("l", "h").limit(MAX_LANGUAGES * sample_lines + 1).collect()
    if len({r.l for r in chosen}) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not chosen:
        return {}
    lines = rows.where(F.col("h").isin([r.h for r in chosen])).groupBy("l", "h").agg(F.min(F.left("t", F.lit(LINE_BYTES))).alias("t"))
    found: dict[str, list[bytes]] = {}
    for r in lines.orderBy("l", "h").collect():
        found.setdefault(r.l, []).append(normal(r.t)[:LINE_BYTES])
    # Dictionaries of one size, so that no language gains by its share of the rows; a language with a small sample does not count.
    sampled = [sum(map(len, v)) + len(v) for v in found.values()]
    size = min([DICT_BYTES, *(n for n in sampled if n >= LEAST_BYTES)])
    seen = {r.l: r.n for r in per_line.where("l = l2").groupBy("l").agg(F.count("*").alias("n")).collect()}
    return {k: b" ".join(found[k])[-size:] for k in sorted(found, key=lambda k: (-seen[k], k))}


def classify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", margin: float = MARGIN) -> DataFrame:
    """Add ``lang_pred``, ``score``, ``margin`` and ``rejected``, judged from the text alone.

    ``margin`` is the share of bytes that the winner saves against the runner-up;
    below the parameter the text is rejected. The score is 2**-b normalised over the
    languages, b being the bytes above the winner's.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    @F.pandas_udf(_PREDICTION)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import zstandard as zstd

        names = list(shared.value)
        packers = []
        for name in names:
            content = zstd.ZstdCompressionDict(shared.value[name], dict_type=zstd.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            packers.append(
                zstd.ZstdCompressor(level=LEVEL, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False)
            )
        undefined = (UNDEFINED, 0.0, 0.0, True)

        def judge(t: str | None) -> tuple:
            if not names or t is None or not any(map(str.isalpha, t)):
                return undefined
            raw = normal(t)
            blocks = [raw[i : i + BLOCK_BYTES] for i in range(0, len(raw), BLOCK_BYTES)]
            took = [sum(len(p.compress(b)) for b in blocks) for p in packers]
            first = min(range(len(names)), key=took.__getitem__)
            rest = sorted(took[:first] + took[first + 1 :])
            gain = (rest[0] - took[first]) / max(rest[0], 1) if rest else 1.0
            score = 1 / sum(2.0 ** -min(x - took[first], 60) for x in took)
            return names[first], score, gain, gain < margin

        for batch in batches:
            yield pd.DataFrame([judge(t) for t in batch], columns=["lang_pred", "score", "margin", "rejected"])

    out = docs.withColumn("_lid", predict(F.col(text)))
    names = ["lang_pred", "score", "margin", "rejected"]
    return out.select(*[docs[f"`{c}`"] for c in docs.columns if c not in names], *[F.col(f"_lid.{c}") for c in names])
