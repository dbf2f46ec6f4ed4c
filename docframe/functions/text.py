"""Text normalisation and tokenisation as Spark SQL expressions.

Each helper takes and returns SQL expression text, to be used in ``selectExpr``,
``expr`` or a statement: everything stays inside the JVM and the optimizer sees it.
"""

from __future__ import annotations

# The characters Python's str.strip() and str.split() treat as blank.
BLANKS = (
    r"'\t\n\u000b\u000c\r\u001c\u001d\u001e\u001f \u0085       "
    r"          　'"
)
BLANK_RUN = r"r'(?U)[\s\x1c-\x1f]+'"
SOLID_RUN = r"r'(?U)[^\s\x1c-\x1f]+'"
# Word and sentence patterns shared by BM25 and answer scoring.
WORD = "'[A-Za-z0-9_]+'"
SENTENCE_GAP = r"r'(?U)(?<=[.!?])[\s\x1c-\x1f]+'"


def lit(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strip(c: str) -> str:
    return f"btrim({c}, {BLANKS})"


def normalize_query(c: str) -> str:
    """Strip and collapse whitespace."""
    return f"btrim(regexp_replace({c}, {BLANK_RUN}, ' '), ' ')"


def solid_runs(c: str) -> str:
    """Array of the runs of non-blank characters."""
    return f"regexp_extract_all({c}, {SOLID_RUN}, 0)"


def token_count(c: str) -> str:
    """0 for empty text, else the number of non-blank runs but at least 1."""
    return f"IF(coalesce({c}, '') = '', 0, greatest(1, size({solid_runs(c)})))"


def words(c: str) -> str:
    """Lower-cased ASCII words, in order, with repeats."""
    return f"transform(regexp_extract_all({c}, {WORD}, 0), w -> lower(w))"


def word_set(c: str) -> str:
    return f"array_distinct({words(c)})"


def split_sentences(c: str) -> str:
    """Split after . ! ? followed by whitespace; trim; drop empties (Q1)."""
    return f"filter(transform(split({strip(c)}, {SENTENCE_GAP}), s -> {strip('s')}), s -> s <> '')"


def overlap_of_sets(q: str, s: str) -> str:
    return (
        f"IF(size({q}) = 0 OR size({s}) = 0, 0D, "
        f"CAST(size(array_intersect({q}, {s})) AS DOUBLE) / size({q}))"
    )


def overlap_score(question: str, sentence: str) -> str:
    """Share of the question's distinct words that the sentence contains (Q2)."""
    return overlap_of_sets(word_set(question), word_set(sentence))


def long_words(c: str, longer_than: int = 4) -> str:
    """Distinct lower-cased whitespace words above a length."""
    return f"array_distinct(transform(filter({solid_runs(c)}, w -> length(w) > {longer_than}), w -> lower(w)))"


def clean_filename(c: str) -> str:
    """Base name with runs outside [A-Za-z0-9._-] replaced by one underscore."""
    base = f"substring_index(rtrim('/', replace({c}, '\\\\', '/')), '/', -1)"
    name = f"btrim(regexp_replace({base}, '[^A-Za-z0-9._-]+', '_'), '._')"
    return f"coalesce(nullif({name}, ''), 'upload.pdf')"
