"""Lines that repeat an earlier line exactly or within one edit.

Segment-partition join (Pass-Join): with a threshold of one edit a line is split into
two segments. Of two lines within one edit, one segment of the shorter line is untouched
and stands in the longer line at the same place or, if the edit lies before it, one
further; so a line of length n is indexed by its two segments and probes the index of
its own length and of the length below. Lines that share a segment are candidates.

Small groups of candidates are compared directly. A group above ``SMALL_GROUP`` lines is
split again: what remains besides the shared segment falls into two segments in the same
way, so groups get more specific from level to level, each line keeping two keys a level.
When at most ``SHORT_REST`` characters remain, lines of equal length are within one edit
iff they agree after deleting one place, and a longer line is within one edit of a
shorter one iff a deletion gives it; lines that agree form a star around the first. No
group is paired off and no link between groups is lost. Candidates are verified by banded
bit-parallel edit distance over the diagonals.

DataFrame functions only. A line is a repeat if an equal line, or one within one edit,
comes earlier, in the order of document id and line number; repeats of repeats count.
Lines shorter than ``NEAR_CHARS`` are compared exactly. Blank lines are never repeats.

Defined results: a null text has no lines; rows that repeat id and text count as one
document. Documents with one id and other texts come in the order of a hash of their
text; documents without id come first. An empty table gives an empty result. Extra
columns are passed on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 1
NEAR_CHARS = 20
SMALL_GROUP = 16
SHORT_REST = 4


# Keys of a line x of n characters: its two index keys and its two probes one length below.
_KEYS = {
    "k0": "xxhash64(0, n, left(x, n DIV 2))",
    "k1": "xxhash64(1, n, substring(x, n DIV 2 + 1))",
    "k2": "xxhash64(0, n - 1, left(x, (n - 1) DIV 2))",
    "k3": "xxhash64(1, n - 1, substring(x, (n - 1) DIV 2 + 2))",
}
_KEY_ROWS = """array(
  named_struct('k', k0, 'side', 0, 'own', true), named_struct('k', k1, 'side', 1, 'own', true),
  named_struct('k', k2, 'side', 0, 'own', false), named_struct('k', k3, 'side', 1, 'own', false))"""


_REST = """CASE WHEN side = 0 AND own THEN substring(x, n DIV 2 + 1) WHEN side = 0 THEN substring(x, (n - 1) DIV 2 + 1)
  WHEN own THEN left(x, n DIV 2) ELSE left(x, (n - 1) DIV 2 + 1) END"""


# Length of the rest r of an index line; a probe has one character more.
_INDEX_LENGTH = "length(r) - IF(own, 0, 1)"
_CUT = f"(({_INDEX_LENGTH}) DIV 2)"
_HALVES = f"""array(
  named_struct('side', 0, 'part', left(r, {_CUT}), 'r', substring(r, {_CUT} + 1)),
  named_struct('side', 1, 'part', substring(r, {_CUT} + IF(own, 1, 2)), 'r', left(r, {_CUT} + IF(own, 0, 1))))"""


def within(rows: DataFrame, a: str, b: str, threshold: int = THRESHOLD) -> DataFrame:
    """Rows whose columns ``a`` and ``b`` are at most ``threshold`` edits apart.

    Bit d of word e tells whether diagonal d - threshold is reached with at most e
    edits; one step per character of ``b`` moves all diagonals of the band at once."""
    full = (1 << (2 * threshold + 1)) - 1
    p, c = f"split({a}, '')", f"split({b}, '')"
    masks = ""
    for d in range(2 * threshold + 1):
        shift = d - threshold
        moved = f"concat(array_repeat('', {-shift}), {p})" if shift <= 0 else f"slice({p}, {shift + 1}, length({a}))"
        equal = f"zip_with({c}, {moved}, (x, y) -> IF(x = y, {1 << d}, 0))"
        masks = f"zip_with({masks}, {equal}, (x, y) -> coalesce(x, 0) | coalesce(y, 0))" if masks else equal
    words, moved = [], ""
    for e in range(threshold + 1):
        before, moved = moved, f"(s.r{e} & m)"
        if e:
            moved = f"({moved} | s.r{e - 1} | shiftright(s.r{e - 1}, 1) | (shiftleft({before}, 1) & {full}))"
        words.append(f"'r{e}', {moved}")
    start = ", ".join(f"'r{e}', {sum(1 << (threshold + d) for d in range(e + 1))}" for e in range(threshold + 1))
    # Arrays are built outside of the lambdas: inside, they would be built once per character.
    last = f"aggregate(slice({masks}, 1, length({b})), named_struct({start}), (s, m) -> named_struct({', '.join(words)})).r{threshold}"
    near = rows.where(f"abs(length({a}) - length({b})) <= {threshold}")
    return near.where(f"({last} & shiftleft(1, length({a}) - length({b}) + {threshold})) != 0")


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Lines that can repeat: id, doc (hash of id and text), pos, h1, h2, k0 to k3 (null if compared exactly only)."""
    rows = docs.select(
        F.xxhash64(F.col(key), F.col(text)).alias("doc"), F.col(key).alias("id"), F.posexplode(F.split(F.col(text), "\n")).alias("pos", "x")
    ).where("x RLIKE '[^\\\\s]'")
    keys = [f"IF(n >= {NEAR_CHARS}, {k}, NULL) AS {name}" for name, k in _KEYS.items()]
    return rows.selectExpr("id", "doc", "pos", "x", "length(x) AS n").selectExpr("id", "doc", "pos", "xxhash64(x) AS h1", "xxhash64(1, x) AS h2", *keys)


def _small_pairs(members: DataFrame) -> DataFrame:
    """Pairs of the small groups: two index lines, or an index line and a probe."""
    small = members.where(f"members <= {SMALL_GROUP}").select("k", "at", "own")
    left = small.where("own").select("k", F.col("at").alias("a"))
    return left.join(small.select("k", F.col("at").alias("b"), "own"), "k").where("own AND a < b OR NOT own AND a != b").select("a", "b")


def _stars(rest: DataFrame, scratch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links of groups whose lines differ only in the short rest r, by every single deletion."""
    deleted = """transform(sequence(1, length(r)), i -> named_struct(
        'h', xxhash64(concat(left(r, i - 1), substring(r, i + 1))), 'place', IF(own, i, 0)))"""
    whole = "array(named_struct('h', xxhash64(r), 'place', 0))"
    forms = rest.selectExpr(
        "k", "at", "own", f"explode(CASE WHEN r = '' THEN {whole} WHEN own THEN concat({deleted}, {whole}) ELSE array_distinct({deleted}) END) AS f"
    ).selectExpr("k", "f.h", "f.place", "at", "own")
    stars = forms.groupBy("k", "h", "place").agg(
        F.count("*").alias("n"), F.expr("IF(place > 0, min(at), min(at) FILTER (WHERE own))").alias("a")
    )
    stars = scratch(stars.where("n > 1 AND a IS NOT NULL").drop("n"))
    return forms.join(stars, ["k", "h", "place"]).select("a", F.col("at").alias("b")).where("a != b")


def near_pairs(distinct: DataFrame, docs: DataFrame, scratch: Callable[[DataFrame], DataFrame], text: str, doc: Column) -> DataFrame:
    """Distinct lines within one edit: a, b (places in the order). Big groups give the star around their first line."""
    rows = distinct.where("k0 IS NOT NULL").select("at", F.explode(F.expr(_KEY_ROWS)).alias("s")).select("at", "s.*")
    groups = rows.groupBy("k").agg(F.count("*").alias("members"), F.count_if("own").alias("owners"))
    groups = scratch(groups.where("members > 1 AND owners > 0").select("k", "members"))
    members = scratch(rows.join(groups, "k"))
    # Texts of the members, cut from their documents.
    asked = members.select("at.doc", "at.pos").distinct().groupBy("doc").agg(F.collect_set("pos").alias("pos"))
    texts = docs.select(doc.alias("doc"), F.split(F.col(text), "\n").alias("lines")).join(asked, "doc")
    texts = texts.select("doc", "lines", F.explode("pos").alias("pos")).select("doc", "pos", F.expr("lines[pos]").alias("x"))
    texts = scratch(texts.dropDuplicates(["doc", "pos"]))

    pairs = _small_pairs(members)
    big = members.where(f"members > {SMALL_GROUP}").selectExpr("*", "at.doc", "at.pos").join(texts, ["doc", "pos"])
    rest = scratch(big.selectExpr("k", "at", "own", "x", "length(x) AS n", "side").selectExpr("k", "at", "own", f"{_REST} AS r"))
    starred = None
    while True:
        found = _stars(rest.where(f"{_INDEX_LENGTH} <= {SHORT_REST}"), scratch)
        starred = found if starred is None else starred.unionByName(found)
        rest = rest.where(f"{_INDEX_LENGTH} > {SHORT_REST}")
        if rest.isEmpty():
            break
        halves = rest.selectExpr("own", "at", f"explode({_HALVES}) AS s", "k AS above").selectExpr("xxhash64(above, s.side, s.part) AS k", "at", "own", "s.r AS r")
        groups = scratch(halves.groupBy("k").agg(F.count("*").alias("members"), F.count_if("own").alias("owners")).where("members > 1 AND owners > 0").select("k", "members"))
        members = scratch(halves.join(groups, "k"))
        pairs = pairs.unionByName(_small_pairs(members))
        rest = members.where(f"members > {SMALL_GROUP}").drop("members")

    both = pairs.unionByName(starred).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    one = texts.select(F.col("doc").alias("da"), F.col("pos").alias("pa"), F.col("x").alias("xa"))
    two = texts.select(F.col("doc").alias("db"), F.col("pos").alias("pb"), F.col("x").alias("xb"))
    split = both.selectExpr("a", "b", "a.doc AS da", "a.pos AS pa", "b.doc AS db", "b.pos AS pb")
    return within(split.join(one, ["da", "pa"]).join(two, ["db", "pb"]), "xa", "xb").select("a", "b")


def repeats(docs: DataFrame, scratch: Callable[[DataFrame], DataFrame], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines that repeat an earlier one, by document: doc, exact and near (numbers of lines from 0)."""
    lines = scratch(lines_of(docs, key, text))
    at = F.struct("id", "doc", "pos")
    distinct = lines.groupBy("h1", "h2").agg(F.min(F.struct(at.alias("at"), *_KEYS)).alias("f"), F.count("*").alias("n"))
    distinct = scratch(distinct.select("h1", "h2", "n", "f.*"))
    near = scratch(near_pairs(distinct, docs, scratch, text, F.xxhash64(F.col(key), F.col(text))).select(F.col("b").alias("at")).distinct())
    flagged = distinct.select("h1", "h2", "n", "at").join(near.withColumn("near", F.lit(True)), "at", "left")
    flagged = scratch(flagged.where("n > 1 OR near").select("h1", "h2", F.col("at").alias("first"), F.coalesce("near", F.lit(False)).alias("near")))
    found = lines.select("doc", "pos", at.alias("at"), "h1", "h2").join(flagged, ["h1", "h2"]).where("near OR at != first")
    return found.groupBy("doc").agg(
        F.sort_array(F.collect_set(F.expr("IF(at != first, pos, NULL)"))).alias("exact"),
        F.sort_array(F.collect_set(F.expr("IF(at = first, pos, NULL)"))).alias("near"),
    )


def remove_lines(
    docs: DataFrame, scratch: Callable[[DataFrame], DataFrame], key: str = "doc_id", text: str = "text", max_share: float = 1.0
) -> DataFrame:
    """Add ``n_lines``, ``exact`` and ``near`` (repeated lines by number) and ``kept`` (the text without them).

    A document that would lose more than ``max_share`` of its characters is a copy of
    documents rather than a carrier of repeated lines; its text stays whole, and the
    repeats are still reported."""
    own = ["n_lines", "exact", "near", "kept"]
    found = repeats(docs, scratch, key, text).withColumnRenamed("doc", "_doc")
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in own], F.xxhash64(F.col(key), F.col(text)).alias("_doc"))
    none = "CAST(array() AS array<int>)"
    out = rows.join(found, "_doc", "left").withColumns({
        "n_lines": F.coalesce(F.size(F.split(F.col(text), "\n")), F.lit(0)).cast("long") * F.col(text).isNotNull().cast("long"),
        "exact": F.expr(f"coalesce(exact, {none})"), "near": F.expr(f"coalesce(near, {none})"),
    })
    gone = F.concat("exact", "near")
    left = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda x, i: ~F.array_contains(gone, i)), "\n")
    out = out.withColumn("kept", F.when(F.size(gone) == 0, F.col(text)).otherwise(left))
    whole = F.length("kept") < (1 - max_share) * F.length(F.col(text))
    return out.withColumn("kept", F.when(whole, F.col(text)).otherwise(F.col("kept"))).drop("_doc")
