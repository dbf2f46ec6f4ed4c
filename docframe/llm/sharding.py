"""Shards of near-equal bytes by vector bin packing over bytes, tokens and rows.

Equal texts form a group and stay together, unless a group is so large that it would
unbalance a block; such a group is cut into pieces by a hash of the key. Groups are
dealt by hash into blocks of bounded size. Inside a block, groups are placed from the
largest down, each into the shard where the dot product of its vector and the residual
capacity is highest; residuals are carried as shares of the block's totals, bytes
counting most. Blocks are independent, so the work spreads over the cluster and the
deviations of blocks, each below one small group, nearly cancel. Slots number the rows
of a shard without gaps, by key within blocks of bounded size.

Defined results: a null text has no bytes and forms a group of its own with the other
null texts, apart from the empty ones; null keys are allowed. Rows repeated with the
same key are placed one by one. An empty table gives an empty result. Extra columns are
not carried; the result joins back by key.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OVERHEAD = 8  # bytes of a row besides its text
BLOCK_GROUPS = 50_000  # groups packed together
SLICE_ROWS = 20_000  # rows numbered together
CUT = 2  # a group above 1/CUT of a shard's part of a block is cut
WEIGHTS = (1.0, 0.03, 0.03)  # of bytes, tokens and rows


def place(sizes: np.ndarray, n_shards: int, weights: tuple[float, ...] = WEIGHTS, turn: int = 0) -> np.ndarray:
    """Shard of each row of ``sizes`` (one column by dimension), largest first.

    ``turn`` rotates the shard that equal residuals prefer."""
    total = sizes.sum(axis=0)
    share = sizes / np.where(total > 0, total, 1) * np.array(weights)
    order = np.lexsort((np.arange(len(sizes)), -share.sum(axis=1)))
    left = np.ones((n_shards, sizes.shape[1])) / n_shards * np.array(weights)
    out = np.empty(len(sizes), np.int64)
    for i in order.tolist():
        k = int((left @ share[i]).argmax())
        left[k] -= share[i]
        out[i] = k
    return (out + turn) % n_shards


def shard(
    docs: DataFrame, n_shards: int, scratch: Callable[[DataFrame], DataFrame], key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Add size, text_crc32, tokens, shard and slot. ``scratch`` stores a table and reads it back."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("_key"),
        (F.octet_length(t) + OVERHEAD).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col(text).isNull(), t).alias("_h1"),
        F.xxhash64(F.lit(1), t).alias("_h2"),
        (F.length(t) - F.length(F.translate(t, " \n\t\r", "")) + 1).cast("long").alias("tokens"),
        F.xxhash64(F.col(key)).alias("_k"),
    )
    slim = scratch(rows)
    groups = slim.groupBy("_h1", "_h2").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    groups = scratch(groups)
    whole = groups.agg(F.count("*").alias("groups"), F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).first()
    blocks = max(1, math.ceil(whole.groups / BLOCK_GROUPS))
    most = max(1, (whole.bytes or 0) // (blocks * n_shards * CUT))
    cut = groups.where((F.col("bytes") > most) & (F.col("rows") > 1)).select(
        "_h1", "_h2", F.least(F.ceil(F.col("bytes") / most), F.col("rows")).alias("pieces")
    )
    slim = slim.join(cut, ["_h1", "_h2"], "left").withColumn("_piece", F.pmod("_k", F.coalesce("pieces", F.lit(1)))).drop("pieces")
    slim = scratch(slim)
    items = slim.groupBy("_h1", "_h2", "_piece").agg(*[F.sum(c).cast("double").alias(c) for c in ("size", "tokens")], F.count("*").cast("double").alias("n"))
    items = items.withColumn("_block", F.pmod(F.xxhash64("_h1", "_piece"), F.lit(blocks)))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_h1", "_h2", "_piece"], ignore_index=True)
        where = place(pdf[["size", "tokens", "n"]].to_numpy(), n_shards, turn=int(pdf["_block"].iat[0]))
        return pdf[["_h1", "_h2", "_piece"]].assign(shard=where)

    placed = scratch(items.groupBy("_block").applyInPandas(pack, "_h1 long, _h2 long, _piece long, shard int"))
    found = slim.join(placed, ["_h1", "_h2", "_piece"])
    return _slots(found, n_shards, whole.rows, scratch).select(
        F.col("_key").alias(key), "size", "text_crc32", "tokens", "shard", "slot"
    )


def _slots(rows: DataFrame, n_shards: int, n_rows: int, scratch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Gapless numbers within each shard: offset of the block plus number in the block."""
    blocks = max(1, math.ceil((n_rows or 0) / SLICE_ROWS))
    rows = scratch(rows.withColumn("_slice", F.pmod(F.xxhash64("_k", "_h1"), F.lit(blocks))))
    before = Window.partitionBy("shard").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "_slice").count()
    offsets = counts.withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = Window.partitionBy("shard", "_slice").orderBy("_key", "_h1", "_h2")
    return rows.join(offsets, ["shard", "_slice"]).withColumn("slot", F.col("_before") + F.row_number().over(inside) - 1)
