"""A stored lexical index and exact top-k search over it (R2).

The index of a corpus is written once. Its tables are dealt and bucketed by (scope, part),
where a part is a bounded share of a scope's chunks, so everything a chunk needs lies in
one bucket and a search adds up scores without moving a posting:

- ``scopes``: number and mean length of a scope's chunks, and its number of parts;
- ``terms``: chunks that hold a term, and its best gain, per scope;
- ``blocks``: postings of a term in a part by falling gain, ``BLOCK`` to a row, with the
  row's best gain, so that a row is skipped by one comparison before it is opened;
- ``forward``: id, terms and gains of a chunk, to complete the score of a few candidates.

Postings name a chunk by its number in the part.

A search broadcasts or shuffles only query terms, floors and candidates (Spark decides by
their measured size). Index rows are filtered, opened and summed where they are read.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.functions.text import WORD, normalize_query, words
from docframe.operators.ordered import sql, top_per_key
from docframe.session import materialize, scratch_path
from docframe.sources.bucketed import in_place, open_bucketed, write_bucketed

BLOCK = 128  # postings in a row of the index
BUCKET_TOKENS = 2_000_000
PARTS_PER_BUCKET = 4
MAX_BUCKETS = 100_000  # Spark's own limit
SLACK = 1e-5  # scores are compared after rounding to six places
SEEDS = 3  # times k: heads whose full score sets the floor
HEAD_WORDS = 12  # strongest words of a query whose heads are looked at
# Weak words are left out of the first pass as long as they add up to this share of the floor.
# Any share below one is exact; a small one leaves few chunks to complete.
WEAK = 0.1

# Usual constants of the ranking function.
K1, B = 1.5, 0.75

SCHEMAS = {
    "scopes": "scope string, n long, avgdl double, parts int",
    "terms": "scope string, part int, term string, df long, top double",
    "blocks": "scope string, part int, term string, block int, top double, docs array<int>, gains array<double>",
    "forward": "scope string, part int, doc int, chunk_id {id}, terms array<string>, gains array<double>",
}
KEYS = ["scope", "part"]


@dataclass(frozen=True)
class LexicalIndex:
    """A written index: its folder, the columns that confine a search, its bucket count."""

    path: str
    scope: tuple[str, ...]
    buckets: int
    id_type: str

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        schema = SCHEMAS[name].replace("{id}", self.id_type)
        if name == "scopes":
            return spark.read.schema(schema).parquet(f"{self.path}/{name}")
        return open_bucketed(spark, f"{self.path}/{name}", schema, KEYS, self.buckets)


def _laid(index: LexicalIndex, rows: DataFrame) -> DataFrame:
    """Rows dealt as the index is, so that a join by scope, part and more moves them and not the index."""
    return rows.repartition(index.buckets, *KEYS)


def scope_key(scope: Sequence[str]) -> str:
    """One text for the values of the confining columns."""
    return f"concat_ws('\\u0001', {', '.join(scope)})" if scope else "''"


def build_index(corpus: DataFrame, path: str, *, scope: Sequence[str] = (), k1: float = K1, b: float = B) -> LexicalIndex:
    """Write the index of ``corpus`` (chunk_id, content and the scope columns) below ``path``.

    One shuffle deals the chunks to their parts; terms are counted, ranked and cut into
    blocks there. A scope of any size is cut into parts of bounded size.
    """
    spark = corpus.sparkSession
    # Texts are dealt, not their words, which take several times the room.
    texts = corpus.selectExpr(f"{scope_key(scope)} AS scope", "chunk_id", "content")
    lengths = texts.selectExpr("scope", f"coalesce(size(regexp_extract_all(content, {WORD}, 0)), 0) AS dl")
    sizes = lengths.groupBy("scope").agg(F.expr("count(*) AS n"), F.expr("avg(dl) AS avgdl"), F.expr("sum(dl) AS total"))
    stored = materialize(sizes)
    total = stored.agg(F.sum("total")).first()[0] or 0
    buckets = int(min(max(8, -(-total // BUCKET_TOKENS)), MAX_BUCKETS))
    part_tokens = max(1000, -(-total // (buckets * PARTS_PER_BUCKET)))
    stored.selectExpr("scope", "n", "avgdl", f"CAST(greatest(1, ceil(total / {part_tokens})) AS INT) AS parts").write.parquet(f"{path}/scopes")
    index = LexicalIndex(path, tuple(scope), buckets, dict(corpus.dtypes)["chunk_id"])

    # The scope is the stored one: of a corpus without scope it would be a constant, which drops out of the
    # keys of a grouping, and what is dealt by it would be dealt again.
    dealt = sql(
        "SELECT s.scope, CAST(pmod(xxhash64(t.chunk_id), s.parts) AS INT) AS part, t.chunk_id, t.content, s.avgdl FROM {t} t JOIN {s} s ON t.scope = s.scope",
        t=texts,
        s=index.table(spark, "scopes"),
    )
    # Words are cut once here: an explode is not merged into what reads it.
    gains = sql(
        f"""
        SELECT scope, part, chunk_id, term, tf * {k1 + 1}D / (tf + {k1}D * (1 - {b}D + {b}D * dl / avgdl)) AS gain
        FROM (SELECT scope, part, chunk_id, dl, avgdl, term, count(*) AS tf
          FROM (SELECT scope, part, chunk_id, avgdl, size(toks) AS dl, explode(toks) AS term FROM (
            SELECT scope, part, chunk_id, avgdl, explode(array({words('content')})) AS toks FROM {{d}}))
          GROUP BY scope, part, chunk_id, dl, avgdl, term)
        """,
        d=dealt.repartition(buckets, *KEYS),
    )
    forward = gains.groupBy(*KEYS, "chunk_id").agg(F.expr("collect_list(term) AS terms"), F.expr("collect_list(gain) AS gains")).selectExpr(
        *KEYS, "row_number() OVER (PARTITION BY scope, part ORDER BY chunk_id) AS doc", "chunk_id", "terms", "gains"
    )
    write_bucketed(forward, f"{path}/forward", KEYS, buckets, ["scope", "part", "doc"])
    # The postings are the forward rows turned over: read back where they lie, without another exchange.
    postings = index.table(spark, "forward").selectExpr("scope", "part", "doc", "inline(arrays_zip(terms, gains)) AS (term, gain)")
    blocks = sql(
        f"""
        SELECT scope, part, term, block, top,
          transform(held, x -> x.d) AS docs, transform(held, x -> x.g) AS gains
        FROM (SELECT scope, part, term, block, max(gain) AS top, array_sort(collect_list(named_struct('p', place, 'd', doc, 'g', gain))) AS held
          FROM (SELECT *, CAST((place - 1) DIV {BLOCK} AS INT) AS block FROM (
            SELECT *, row_number() OVER (PARTITION BY scope, part, term ORDER BY gain DESC, doc) AS place FROM {{p}}))
          GROUP BY scope, part, term, block)
        """,
        p=postings,
    )
    write_bucketed(blocks, f"{path}/blocks", KEYS, buckets, ["scope", "part", "term", "block"])
    terms = sql(
        "SELECT scope, part, term, sum(size(gains)) AS df, max(top) AS top FROM {b} GROUP BY scope, part, term",
        b=index.table(spark, "blocks"),
    )
    write_bucketed(terms, f"{path}/terms", KEYS, buckets, ["scope", "part", "term"])
    meta = {"scope": list(scope), "buckets": buckets, "id_type": index.id_type}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{path}/meta")
    return index


def open_index(spark: SparkSession, path: str) -> LexicalIndex:
    """An index written earlier, by any session."""
    meta = json.loads(spark.read.text(f"{path}/meta").first().value)
    return LexicalIndex(path, tuple(meta["scope"]), meta["buckets"], meta["id_type"])


def query_weights(index: LexicalIndex, queries: DataFrame) -> DataFrame:
    """Words of each query that its scope holds, with their weight and best gain."""
    spark = queries.sparkSession
    asked = sql(
        """
        SELECT query_id, scope, term, count(*) AS qtf
        FROM (SELECT query_id, scope, explode(toks) AS term FROM {q}) GROUP BY query_id, scope, term
        """,
        q=queries.selectExpr("query_id", f"{scope_key(index.scope)} AS scope", f"{words(normalize_query('query'))} AS toks"),
    )
    wanted = materialize(asked)
    # Spread over the parts of its scope, a word meets the vocabulary where that lies.
    spread = sql(
        "SELECT d.scope, explode(sequence(0, s.parts - 1)) AS part, d.term FROM (SELECT DISTINCT scope, term FROM {q}) d JOIN {s} s ON d.scope = s.scope",
        q=wanted,
        s=index.table(spark, "scopes"),
    )
    held = sql(
        "SELECT scope, term, sum(df) AS df, max(top) AS top FROM {t} JOIN {w} USING (scope, part, term) GROUP BY scope, term",
        t=index.table(spark, "terms"),
        w=_laid(index, spread),
    )
    return sql(
        """
        SELECT query_id, scope, term, qtf * ln(1 + (n - df + 0.5D) / (df + 0.5D)) AS w, top, parts
        FROM {q} JOIN {h} USING (scope, term) JOIN {s} USING (scope)
        """,
        q=wanted,
        h=held,
        s=index.table(spark, "scopes"),
    )


def _opened(index: LexicalIndex, words_of: DataFrame, condition: str = "true") -> DataFrame:
    """Summed gains per query and chunk over the rows of ``blocks`` that meet ``condition`` (over b
    and w): a row that does not is never opened, and none is moved."""
    return sql(
        f"""
        SELECT scope, part, query_id, doc, sum(w * gain) AS score
        FROM (SELECT scope, part, query_id, w, inline(arrays_zip(docs, gains)) AS (doc, gain) FROM (
          SELECT b.scope, b.part, w.query_id, w.w, b.docs, b.gains
          FROM {{b}} b JOIN {{w}} w ON b.scope = w.scope AND b.part = w.part AND b.term = w.term WHERE {condition}))
        GROUP BY scope, part, query_id, doc
        """,
        b=index.table(words_of.sparkSession, "blocks"),
        w=_spread(index, words_of),
    )


def _spread(index: LexicalIndex, words_of: DataFrame) -> DataFrame:
    """Words of queries at each part of their scope."""
    return _laid(index, words_of.selectExpr("*", "explode(sequence(0, parts - 1)) AS part"))


def _completed(index: LexicalIndex, weights: DataFrame, chosen: DataFrame) -> DataFrame:
    """Full scores of chosen (scope, part, query_id, doc), from the chunks' own terms."""
    return sql(
        """
        WITH terms AS (
          SELECT f.scope, f.part, c.query_id, f.chunk_id, inline(arrays_zip(f.terms, f.gains)) AS (term, gain)
          FROM {f} f JOIN {c} c ON f.scope = c.scope AND f.part = c.part AND f.doc = c.doc)
        SELECT t.query_id, t.chunk_id, sum(w.w * t.gain) AS score FROM terms t
        JOIN {w} w ON t.scope = w.scope AND t.part = w.part AND t.query_id = w.query_id AND t.term = w.term
        GROUP BY t.scope, t.part, t.query_id, t.chunk_id
        """,
        f=index.table(weights.sparkSession, "forward"),
        c=_laid(index, chosen),
        w=_spread(index, weights),
    )


def search(index: LexicalIndex, queries: DataFrame, k: int) -> DataFrame:
    """Exact top ``k`` chunks per query (query_id, chunk_id, score, rank) from a stored index.

    The best rows of the strongest words' postings name a few chunks per query; the k-th best
    full score among them is a floor that the true top k cannot fall below. The weakest words,
    whose best gains together stay under a share of the floor, cannot lift a chunk alone (the
    MaxScore rule of Turtle and Flood, 1995): chunks are found through the others, and a row of postings is left closed if its best gain and all
    other words' best gains stay under it (block-max, Ding and Suel, 2011). What is left is
    completed from the chunks' own terms. The result is stored, so that all joins with the index are run here.
    """
    with in_place(queries.sparkSession):
        return materialize(_ranked(index, queries, k))


def _ranked(index: LexicalIndex, queries: DataFrame, k: int) -> DataFrame:
    weights = materialize(query_weights(index, queries))
    strong = top_per_key(weights, ["query_id"], HEAD_WORDS, "w * top DESC, term")
    heads = top_per_key(_opened(index, strong, "b.block = 0"), ["query_id"], SEEDS * k, "score DESC, part, doc").drop("score")
    floors = sql(
        f"""
        SELECT query_id, score AS floor FROM (
          SELECT query_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC) AS place FROM {{f}}) WHERE place = {k}
        """,
        f=_completed(index, weights, materialize(heads)),
    )
    split = sql(
        f"""
        SELECT *, sum(IF(lifting, 0D, w * top)) OVER (PARTITION BY query_id, scope) AS rest FROM (
          SELECT {{w}}.*, coalesce(floor, 0D) AS floor, sum(w * top) OVER (PARTITION BY query_id, scope) - w * top AS others,
            sum(w * top) OVER (PARTITION BY query_id, scope ORDER BY w * top, term) >= {WEAK}D * coalesce(floor, 0D) - {SLACK}D AS lifting
          FROM {{w}} LEFT JOIN {{f}} USING (query_id))
        """,
        w=weights,
        f=floors,
    )
    split = materialize(split)
    found = sql(
        f"""
        SELECT f.scope, f.part, f.query_id, f.doc FROM {{f}} f
        JOIN (SELECT query_id, max(rest) AS rest, max(floor) AS floor FROM {{s}} GROUP BY query_id) s ON f.query_id = s.query_id
        WHERE f.score + s.rest >= s.floor - {SLACK}D
        """,
        f=_opened(index, split.where("lifting"), f"w.w * b.top + w.others >= w.floor - {SLACK}D"),
        s=split,
    )
    scored = _completed(index, weights, materialize(found)).withColumn("score", F.round("score", 6))
    return top_per_key(scored, ["query_id"], k, "score DESC, chunk_id", rank="rank")


def scratch_index(corpus: DataFrame, scope: Sequence[str] = (), k1: float = K1, b: float = B) -> LexicalIndex:
    """An index in the shared scratch folder, for one search over a corpus that has none."""
    return build_index(corpus, scratch_path(corpus.sparkSession, "lexical"), scope=scope, k1=k1, b=b)
