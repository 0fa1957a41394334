"""K-d tree sharding on metadata, with DataFrame functions only.

Items are groups of rows with equal texts, weighted by their bytes. A node of the tree that has to become k shards is
split at the weighted quantile k // 2 : k along its widest metadata dimension, until every leaf is one shard. Each
level is one pass for the extents and PASSES passes for the quantiles: every pass sums weights in BINS bins of the
key and narrows the key of each node to one bin, so a node's median is found without sorting or gathering rows. What
reaches the driver is bounded by shards times bins.

A key is a dimension's value in 16 bits and then 20 bits of a hash, so a dimension with few values can be split
anywhere. Equal texts stay in one shard. Only a group that alone outweighs a shard cannot: it is dealt by doc_id into
parts of a sixteenth of a shard, and there are fewer such groups than shards.

Defined results: a null text has no bytes and stands alone; empty texts are a group; repeated rows keep a slot each;
shards can be empty when there are few rows; an empty table gives no rows; null metadata count as a value.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

VALUE_BITS, HASH_BITS, STEP_BITS = 16, 20, 12
PASSES = (VALUE_BITS + HASH_BITS) // STEP_BITS
BINS = 1 << STEP_BITS
#: What every row adds to its text's bytes.
ROW_BYTES = 16
#: Rows of a block that get their slots in one task.
SLOT_ROWS = 5000


def _by_node(values: dict[int, int], node: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), node)


def _choose(dims: dict[int, int], keys: list[Column], node: Column) -> Column:
    """The key along each node's own dimension."""
    dim = _by_node(dims, node)
    out = keys[0]
    for d, key in enumerate(keys[1:], 1):
        out = F.when(dim == d, key).otherwise(out)
    return out


def _quantiles(items: DataFrame, keys: list[Column], dims: dict[int, int], goal: dict[int, float]) -> dict[int, int]:
    """For each node the key up to which the weight comes nearest to the goal."""
    open_ = items.where(F.col("node").isin(list(dims)))
    prefix = dict.fromkeys(dims, 0)
    below = dict.fromkeys(dims, 0.0)
    for k in range(PASSES):
        left = STEP_BITS * (PASSES - 1 - k)
        key = _choose(dims, keys, F.col("node"))
        rows = open_.select("node", "weight", key.alias("key"))
        if k:
            rows = rows.where(F.shiftright("key", left + STEP_BITS) == _by_node(prefix, F.col("node")))
        bins = rows.groupBy("node", F.shiftright("key", left).alias("bin")).agg(F.sum("weight").alias("w")).collect()
        by: dict[int, list[tuple[int, int]]] = {}
        for r in bins:
            by.setdefault(r.node, []).append((r.bin, r.w))
        for node, found in by.items():
            found.sort()
            total = below[node]
            for i, (b, w) in enumerate(found):
                if total + w >= goal[node] or i == len(found) - 1:
                    break
                total += w
            if k == PASSES - 1:  # the border falls before or behind the last bin, whichever is nearer
                prefix[node] = b if total + w - goal[node] <= goal[node] - total else b - 1
            else:
                prefix[node], below[node] = b, total
    return prefix


def assign(docs: DataFrame, scratch: Scratch, *, shards: int = 40, target_bytes: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row; with `target_bytes` the count of shards follows from it."""
    text, words = F.col("text"), F.xxhash64("text")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.when(text.isNull(), F.xxhash64("doc_id")).otherwise(words).alias("same"),
        text.isNull().alias("none"),
        *[F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(1 << VALUE_BITS)).cast("long").alias(c) if c in docs.columns else F.lit(0).cast("long").alias(c) for c in ("lang", "source")],
    )
    rows = scratch.keep(rows, "rows")
    n, total, low, high, most = rows.agg(F.count("*"), F.sum("size"), F.min("doc_id"), F.max("doc_id"), F.max("size")).first()
    if target_bytes:
        shards = max(1, -(-(total or 0) // target_bytes))
    group = ["same", "size", "text_crc32", "none"]
    share = max(1.0, (total or 0) / shards)
    heavy = rows.groupBy(*group).agg(F.sum("size").alias("w")).where(F.col("w") > share)
    heavy = heavy.select(*group, F.ceil(F.col("w") / (share / 16)).alias("parts"))  # fewer rows than shards
    rows = rows.join(F.broadcast(heavy), group, "left")
    rows = rows.withColumn("part", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("parts")), F.lit(0))).drop("parts")
    unit = [*group, "part"]
    top = (1 << VALUE_BITS) - 1
    scaled = lambda x, a, b: F.least(F.lit(top), F.greatest(F.lit(0), (x - a) / max(b - a, 1e-9) * top)).cast("long")
    items = rows.groupBy(*unit).agg(F.sum("size").alias("weight"), F.min("doc_id").alias("first"), F.min("lang").alias("d2"), F.min("source").alias("d3"))
    items = items.withColumn("d0", scaled(F.col("first"), low or 0, high or 0))
    items = items.withColumn("d1", scaled(F.log("size"), math.log(ROW_BYTES), math.log(max(most or 0, ROW_BYTES + 1))))
    items = items.withColumn("salt", F.pmod(F.xxhash64(*unit), F.lit(1 << HASH_BITS)))
    dims = ["d0", "d1", "d2", "d3"]
    items = scratch.keep(items.select(*unit, "weight", *dims, "salt", F.lit(1).cast("long").alias("node")), "items")
    keys = [F.shiftleft(d, HASH_BITS) + F.col("salt") for d in dims]
    wanted = {1: shards}  # shards of each node; node i has the children 2i and 2i + 1
    first_shard = {1: 0}
    leaves = {}
    while True:
        for node in [x for x, k in wanted.items() if k == 1]:
            leaves[node] = first_shard[node]
            del wanted[node]
        if not wanted:
            break
        extents = items.where(F.col("node").isin(list(wanted))).groupBy("node").agg(F.sum("weight").alias("w"), *[(F.max(d) - F.min(d)).alias(d) for d in dims]).collect()
        widest = {r.node: max(range(len(dims)), key=lambda d: (r[dims[d]], -d)) for r in extents}
        goal = {r.node: r.w * (wanted[r.node] // 2) / wanted[r.node] for r in extents}
        border = _quantiles(items, keys, widest, goal) if widest else {}
        after, starts = {}, dict(first_shard)
        for node, k in wanted.items():
            after |= {2 * node: k // 2, 2 * node + 1: k - k // 2}
            starts |= {2 * node: first_shard[node], 2 * node + 1: first_shard[node] + k // 2}
        if border:
            over = _choose(widest, keys, F.col("node")) > _by_node(border, F.col("node"))
            moved = F.when(F.col("node").isin(list(border)), F.col("node") * 2 + over.cast("long")).otherwise(F.col("node"))
            before, items = items, scratch.keep(items.withColumn("node", moved), "items")
            scratch.drop(before)
        wanted, first_shard = after, starts
    placed = items.select(*unit, _by_node(leaves, F.col("node")).cast("int").alias("shard"))
    sharded = scratch.keep(rows.join(placed, unit).select("doc_id", "size", "text_crc32", "shard"), "sharded")
    blocks = max(8, -(-n // (shards * SLOT_ROWS)))
    sharded = sharded.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(blocks)))
    counts = scratch.keep(sharded.groupBy("shard", "block").agg(F.count("*").alias("n")), "counts")
    upto = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = scratch.keep(counts.select("shard", "block", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("offset")), "offsets")
    within = Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size")
    out = sharded.withColumn("rank", F.row_number().over(within) - 1).join(offsets, ["shard", "block"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("rank") + F.col("offset")).cast("long").alias("slot"))
