"""Bibliographic records: normalising dumps, duplicates, library matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.functions.text import strip
from docframe.operators.ordered import first_per_key, sql, top_per_key

OPENALEX = (
    "struct<id:string,display_name:string,publication_year:int,cited_by_count:int,ids:struct<doi:string>,"
    "authorships:array<struct<author:struct<display_name:string>>>,"
    "primary_location:struct<source:struct<display_name:string>>,open_access:struct<is_oa:boolean,oa_url:string>>"
)
ARXIV_ENTRY = (
    "id string, title string, summary string, published string, author array<struct<name:string>>, "
    "link array<struct<_href:string,_title:string,_type:string>>"
)
RECORD = (
    "title", "abstract", "authors", "year", "venue", "doi", "arxiv_id", "source", "source_url", "pdf_url",
    "citation_count", "open_access",
)


def normalize_openalex(raw: DataFrame, column: str = "json") -> DataFrame:
    """Works of an API dump, one JSON work per row, as records."""
    keep = [c for c in raw.columns if c != column]
    return raw.selectExpr(*keep, f"from_json({column}, '{OPENALEX}') AS w").selectExpr(
        *keep,
        "coalesce(nullif(w.display_name, ''), 'Untitled') AS title",
        "CAST(NULL AS STRING) AS abstract",
        "filter(coalesce(w.authorships.author.display_name, CAST(array() AS array<string>)), a -> coalesce(a, '') <> '') AS authors",
        "nullif(w.publication_year, 0) AS year",
        "w.primary_location.source.display_name AS venue",
        "replace(nullif(w.ids.doi, ''), 'https://doi.org/', '') AS doi",
        "CAST(NULL AS STRING) AS arxiv_id",
        "'openalex' AS source",
        "w.id AS source_url",
        "w.open_access.oa_url AS pdf_url",
        "w.cited_by_count AS citation_count",
        "coalesce(w.open_access.is_oa, false) AS open_access",
    )


def normalize_arxiv(entries: DataFrame) -> DataFrame:
    """Atom entries (columns of ARXIV_ENTRY) as records."""
    keep = [c for c in entries.columns if c not in ("id", "title", "summary", "published", "author", "link")]
    text = lambda c: f"replace({strip(f'coalesce({c}, chr(32))')}, '\\n', ' ')"
    pdf = "filter(link, l -> coalesce(l._title = 'pdf', false) OR coalesce(l._type = 'application/pdf', false))"
    return entries.selectExpr(
        *keep,
        f"{text('title')} AS title",
        f"{text('summary')} AS abstract",
        f"filter(transform(coalesce(author.name, CAST(array() AS array<string>)), a -> {strip('a')}), a -> coalesce(a, '') <> '') AS authors",
        "IF(left(published, 4) RLIKE '^[0-9]+$', CAST(left(published, 4) AS INT), NULL) AS year",
        "'arXiv' AS venue",
        "CAST(NULL AS STRING) AS doi",
        "substring_index(coalesce(id, ''), '/', -1) AS arxiv_id",
        "'arxiv' AS source",
        "coalesce(id, '') AS source_url",
        f"try_element_at({pdf}, -1)._href AS pdf_url",
        "CAST(NULL AS INT) AS citation_count",
        "true AS open_access",
    )


def record_identity() -> str:
    """DOI, else arXiv id, else title; lower-cased and stripped; empty counts as missing."""
    return strip("lower(coalesce(nullif(doi, ''), nullif(arxiv_id, ''), title))")


def dedupe_records(records: DataFrame, position: str) -> DataFrame:
    """First record per identity (D1); a hot identity sends one row per map task."""
    marked = records.withColumn("identity", F.expr(record_identity()))
    return first_per_key(marked, ["identity"], position)


_KEYS = {
    "doi": "lower(nullif(doi, ''))",
    "arxiv": "lower(nullif(arxiv_id, ''))",
    "title": strip("lower(nullif(title, ''))"),
}


def library_keys(papers: DataFrame) -> DataFrame:
    """Match keys of library papers, one row per paper and key."""
    return _keyed(papers, "paper_id")


def _keyed(df: DataFrame, ident: str) -> DataFrame:
    pairs = ", ".join(f"'{n}', {e}" for n, e in _KEYS.items())
    return df.selectExpr("user_id", ident, f"stack({len(_KEYS)}, {pairs}) AS (kind, key)").filter("key IS NOT NULL")


_COMBOS = [("doi",), ("arxiv",), ("title",), ("doi", "arxiv"), ("doi", "title"), ("arxiv", "title"), ("doi", "arxiv", "title")]


def _combined(df: DataFrame, ident: str) -> DataFrame:
    """One row per combination of keys that a row has; a key outside the combination is ''."""
    rows = ", ".join(
        f"named_struct('combo', '{'+'.join(c)}', " + ", ".join(f"'{n}', " + (f"k_{n}" if n in c else "''") for n in _KEYS) + ")"
        for c in _COMBOS
    )
    keyed = df.selectExpr(ident, "user_id", *[f"{e} AS k_{n}" for n, e in _KEYS.items()])
    return keyed.selectExpr(ident, "user_id", f"inline(filter(array({rows}), x -> x.doi IS NOT NULL AND x.arxiv IS NOT NULL AND x.title IS NOT NULL))")


def match_keys(records: DataFrame, papers: DataFrame) -> DataFrame:
    """The owner's papers that each record matches, by key (D2): record_id, user_id, kind, key,
    ``papers`` (with that key) and ``fresh`` (of them, those no earlier kind has matched; DOI
    comes first, then arXiv id, then title). A record's papers are the rows of ``library_keys``
    with its keys. Papers are counted per key and per combination of keys and every join meets
    one row per key, so no pair of equal titles is ever formed."""
    found = sql(
        """
        WITH counted AS (SELECT user_id, combo, doi, arxiv, title, count(*) AS n FROM {p} GROUP BY user_id, combo, doi, arxiv, title)
        SELECT record_id, user_id, first(IF(combo = 'doi', doi, NULL), true) AS doi, first(IF(combo = 'arxiv', arxiv, NULL), true) AS arxiv,
          first(IF(combo = 'title', title, NULL), true) AS title, map_from_entries(collect_list(struct(combo, n))) AS n
        FROM {a} JOIN counted USING (user_id, combo, doi, arxiv, title) GROUP BY record_id, user_id
        """,
        p=_combined(papers, "paper_id"),
        a=_combined(records, "record_id"),
    )
    of = lambda c: f"coalesce(n['{c}'], 0L)"
    return found.selectExpr("record_id", "user_id", f"""inline(filter(array(
        named_struct('kind', 'doi', 'key', doi, 'papers', {of('doi')}, 'fresh', {of('doi')}),
        named_struct('kind', 'arxiv', 'key', arxiv, 'papers', {of('arxiv')}, 'fresh', {of('arxiv')} - {of('doi+arxiv')}),
        named_struct('kind', 'title', 'key', title, 'papers', {of('title')},
          'fresh', {of('title')} - {of('doi+title')} - {of('arxiv+title')} + {of('doi+arxiv+title')})), x -> x.papers > 0))""")


def first_matches(records: DataFrame, papers: DataFrame, n: int = 5, after: DataFrame | None = None) -> DataFrame:
    """The first ``n`` papers that each record matches, by paper_id, each once (D2); ``after``
    (record_id, paper_id) asks for those behind a paper, page by page.

    A key hands on its first papers only; where a page starts behind them, those of the
    key's papers that follow it."""
    keys = _keyed(records, "record_id")
    shelf = _keyed(papers, "paper_id")
    if after is None:
        shelf = top_per_key(shelf, ["user_id", "kind", "key"], n, "paper_id")
        pairs = keys.join(shelf, ["user_id", "kind", "key"]).select("record_id", "paper_id")
    else:
        behind = keys.join(after.withColumnRenamed("paper_id", "seen"), "record_id")
        starts = behind.select("user_id", "kind", "key", "seen").distinct()
        pages = starts.join(shelf, ["user_id", "kind", "key"]).where("paper_id > seen")
        pages = top_per_key(pages, ["user_id", "kind", "key", "seen"], n, "paper_id")
        pairs = behind.join(pages, ["user_id", "kind", "key", "seen"]).select("record_id", "paper_id")
    return top_per_key(pairs.distinct(), ["record_id"], n, "paper_id", rank="place")


def match_library(records: DataFrame, papers: DataFrame) -> DataFrame:
    """How many of the owner's papers each record matches, and the first of them.

    A record may match on DOI, arXiv id or title; a paper counts once. ``match_keys`` tells
    by which keys, ``first_matches`` which papers.
    """
    counts = match_keys(records, papers).groupBy("record_id").agg(F.expr("sum(fresh) AS matches"))
    first = first_matches(records, papers, 1).selectExpr("record_id", "paper_id AS first_match")
    return records.select("record_id").join(counts, "record_id", "left").join(first, "record_id", "left").selectExpr(
        "record_id", "coalesce(matches, 0) AS matches", "first_match"
    )


def year_filter(records: DataFrame, year_min: int | None = None, year_max: int | None = None) -> DataFrame:
    """Records within the years, for every source."""
    if year_min:
        records = records.filter(F.col("year") >= year_min)
    if year_max:
        records = records.filter(F.col("year") <= year_max)
    return records


def with_fallback(failed: DataFrame, primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Rows of the secondary source, with a note, for the queries whose call to the primary
    failed (D10; ``failed`` holds their query_id). A query without hits did not fail."""
    failed = failed.select("query_id").distinct()
    primary = primary.join(failed, "query_id", "left_anti")
    note = F.lit("primary_source_failed")
    spare = secondary.join(failed, "query_id", "left_semi").withColumn("warning", note)
    return primary.withColumn("warning", F.lit(None).cast("string")).unionByName(spare)
