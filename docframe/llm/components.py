"""Connected components of a link table, by minimum labels with pointer jumping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(links: DataFrame, scratch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``id``, ``root`` of every id in ``links`` (columns a, b); the root is the smallest id of its component.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each step groups
    links by id, combines before the shuffle, and keeps links to smaller ids only; the
    number of links never grows. Links end up as a star around each root. Every round is
    written to the shared folder.
    """
    edges = scratch(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    before = None
    while True:
        both = edges.union(edges.select("b", "a"))
        low = scratch(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        # Large star: larger neighbours of an id link to its minimum.
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
        edges = scratch(large.distinct())
        # Small star: an id and its smaller neighbours link to the smallest of them.
        least = scratch(edges.groupBy("a").agg(F.min("b").alias("m")))
        small = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.withColumnRenamed("m", "b"))
        edges = scratch(small.where("a > b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    ids = edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return ids.unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
