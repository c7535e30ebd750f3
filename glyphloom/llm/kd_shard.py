"""K-d tree sharding by distributed weighted medians (DataFrame functions only)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, numbered, salts

#: Tables with a row a node are broadcast up to so many nodes, some 10 MB; beyond that they are joined by a shuffle.
MOST_BROADCAST = 100_000
#: Bits of a point's order key that one histogram round settles; 63 bits in all.
ROUNDS = (8,) * 7 + (7,)


def _scaled(value: Column, low: Column, high: Column) -> Column:
    """value as an integer from 0 to 2**31 - 1 between low and high."""
    span = F.coalesce((high - low).cast("double"), F.lit(0.0))
    return F.when(span > 0, F.floor((value - low).cast("double") / span * float(2**31 - 1))).otherwise(F.lit(0)).cast("long")


def _reached(hist: DataFrame, bin_col: str) -> DataFrame:
    """(node, dim, target, bin, base, w): the first bin of each node at which the weights up to it reach the target, or its last."""
    own = W.partitionBy("node")
    upto = F.col("base") + F.sum("w").over(own.orderBy(bin_col).rowsBetween(W.unboundedPreceding, 0))
    last = F.max(bin_col).over(own)
    found = hist.withColumn("upto", upto).withColumn("last", last).where((F.col("upto") >= F.col("target")) | (F.col(bin_col) == F.col("last")))
    found = found.groupBy("node", "dim", "target").agg(F.min(F.struct(F.col(bin_col).alias("bin"), (F.col("upto") - F.col("w")).alias("base"), "w")).alias("s"))
    return found.select("node", "dim", "target", F.col("s.bin").alias("bin"), F.col("s.base").alias("base"), F.col("s.w").alias("w"))


def _median_cuts(points: DataFrame, dims: int, gathered: Callable[[DataFrame], DataFrame], small: Callable[[DataFrame], DataFrame] = F.broadcast) -> DataFrame:
    """(node, dim, cut, with_cut): for each node the widest dimension and the key where the left share ends.

    points: node, share (of the weight that goes left), weight, keys array<long>. One histogram of at most 256 bins a node and
    round. What a round found, a row a node, is ``gathered``, so that no plan holds the rounds before.
    """
    spans = [F.max(F.col("keys")[d]) - F.min(F.col("keys")[d]) for d in range(dims)]
    nodes = points.groupBy("node").agg(F.max("share").alias("share"), F.sum("weight").alias("total"), F.array(*spans).alias("spans"))
    widest = (F.array_position("spans", F.array_max("spans")) - 1).cast("int")
    state = gathered(nodes.select("node", widest.alias("dim"), (F.col("total") * F.col("share")).alias("target"), F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("base")))
    left = sum(ROUNDS)
    for bits in ROUNDS:
        near = points.select("node", "weight", "keys").join(small(state), "node")
        key = F.expr("keys[dim]")
        near = near.where(F.shiftright(key, left) == F.col("prefix")) if left < 63 else near
        left -= bits
        hist = near.groupBy("node", "dim", "target", "base", F.shiftright(key, left).alias("bin")).agg(F.sum("weight").alias("w"))
        cut = gathered(_reached(hist, "bin"))
        state = cut.select("node", "dim", "target", F.col("bin").alias("prefix"), "base")
    nearer = F.abs(F.col("base") + F.col("w") - F.col("target")) < F.abs(F.col("target") - F.col("base"))
    return cut.select("node", "dim", F.col("bin").alias("cut"), nearer.alias("with_cut"))


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = ("lang", "source"), n_shards: int | None = None, target_bytes: int = 256 << 20) -> DataFrame:
    """One row per input row: the id, size, text_crc32, shard, slot.

    Points are the groups of equal texts (null counts as empty), weighted by their bytes plus one a
    row. Dimensions: smallest id, text bytes, and a hash of each ``metadata`` column. A node of s leaves
    is cut at the weighted share floor(s/2)/s along its widest dimension, ties by a hash of the
    text, until each node is one leaf. ``n_shards`` fixes the leaves; else there are as many as
    hold ``target_bytes`` each. ``slot`` counts from 0 without gaps in each shard. Groups never
    divide, so a shard is at most one group's bytes off its share at each cut. Null ids and metadata
    count as 0; columns that are absent are left out; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "kd")
    body = F.coalesce(F.col(text_col), F.lit(""))
    metadata = tuple(m for m in metadata if m in docs.columns)
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.unhex(F.sha2(body, 256)).alias("g"),
        *(F.shiftrightunsigned(F.xxhash64(F.col(m).cast("string")), 33).alias(f"_m{k}") for k, m in enumerate(metadata)),
    )
    rows = scratch.keep(rows, "rows")
    groups = rows.groupBy("g").agg(F.sum("size").alias("weight"), F.coalesce(F.min("id"), F.lit(0)).cast("long").alias("first"), F.max("size").alias("bytes"), *(F.min(f"_m{k}").alias(f"_m{k}") for k in range(len(metadata))))
    groups = scratch.keep(groups, "groups")
    low = groups.agg(F.sum("weight").alias("total"), F.min("first").alias("f0"), F.max("first").alias("f1"), F.min("bytes").alias("b0"), F.max("bytes").alias("b1"))
    total, f0, f1, b0, b1 = low.first()
    total = total or 0
    leaves = n_shards or max(1, math.ceil(total / target_bytes))
    few = leaves <= MOST_BROADCAST
    small = F.broadcast if few else lambda nodes: nodes
    # rows that are broadcast pass the driver anyway: as a local table they leave no files
    gathered = (lambda nodes: spark.createDataFrame(nodes.toArrow(), nodes.schema)) if few else lambda nodes: scratch.keep(nodes, "nodes")
    tie = F.shiftrightunsigned(F.xxhash64("g"), 32)
    values = [_scaled(F.col("first"), F.lit(f0), F.lit(f1)), _scaled(F.col("bytes"), F.lit(b0), F.lit(b1)), *(F.coalesce(F.col(f"_m{k}"), F.lit(0)) for k in range(len(metadata)))]
    keys = F.array(*(F.shiftleft(v.cast("long"), 32).bitwiseOR(tie) for v in values))
    points = groups.select("g", "weight", keys.alias("keys"), F.lit(0).cast("long").alias("node"), F.lit(leaves).cast("long").alias("leaves"))
    read = groups
    # node: its first shard; leaves: how many shards it holds
    for _ in range(max(0, math.ceil(math.log2(leaves)))):
        open_ = points.where("leaves > 1").withColumn("share", F.floor(F.col("leaves") / 2) / F.col("leaves"))
        cuts = _median_cuts(open_, len(values), gathered, small)
        at = points.join(small(cuts), "node", "left").withColumn("_k", F.expr("keys[dim]"))
        to_left = (F.col("_k") < F.col("cut")) | ((F.col("_k") == F.col("cut")) & F.col("with_cut"))
        half = F.floor(F.col("leaves") / 2).cast("long")
        alone = F.col("leaves") == 1
        after = at.select(
            "g", "weight", "keys",
            F.when(alone | to_left, F.col("node")).otherwise(F.col("node") + half).alias("node"),
            F.when(alone, F.col("leaves")).when(to_left, half).otherwise(F.col("leaves") - half).alias("leaves"),
        )
        after = scratch.keep(after, "points")
        scratch.drop(read)
        points = read = after
    placed = rows.select("id", "size", "text_crc32", "g").join(points.select("g", F.col("node").cast("int").alias("shard")), "g").drop("g")
    placed = scratch.keep(placed, "placed")
    scratch.drop(rows)
    out = numbered(placed, ["shard"], ["id", "size", "text_crc32"], "slot", salts(placed.count()))
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))
