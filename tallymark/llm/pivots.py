"""Near-duplicate embeddings by a pivot-permutation index.

Reference points (pivots) are drawn from a bounded sample, spread apart. A vector is described by its NEAREST pivots in
order of nearness. The first PREFIX of them are posting lists of an inverted index, so two vectors meet in a list for
every pivot that stands early in both permutations. Where they meet, shared pivots of the whole permutations are counted
on pivot numbers alone; pairs with SHARED or more are candidates, and only candidates are verified: a link is a cosine,
in double precision, of the limit or more. No verified link is given up. The tests measure recall against brute force.

Equal vectors form one class first. A list of over HOT members is split by the second pivot that two vectors share,
which loses no candidate as a candidate shares SHARED = 2 or more. Every list is cut into blocks, and pairs of blocks are
groups of their own. A pair is verified and counted in one list only (the least of the small lists in which it meets,
else the least split), so nothing is counted twice; what leaves a group is one row per vector (how many links, and a link
that spans the group's components), never its pairs.

Vectors of different lengths have different pivots and never link. Norms are taken after division by the largest
component, so neither very large nor very small vectors overflow.

Defined results: null, empty and zero vectors and vectors with null or non-finite components link with nothing and are
their own component; every row of the table is a vector, repeated rows among them, which link with each other; cosines
equal to the limit link; rows of one id with different vectors share their links; an empty table gives no rows; columns other than the two named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import components

#: About as many rows are read to choose the pivots of all lengths together; the bound of the index's sample.
SAMPLE = 8192
NEAREST, PREFIX, SHARED = 8, 6, 2
#: Rows of a posting list that are compared with another block at once, and members from which a list is split.
BLOCK, HOT = 512, 4096
#: Candidates verified at once.
CHUNK = 1 << 16
_NONE = np.iinfo(np.int32).max


def pivot_count(n: int) -> int:
    """Grows with the root of the table, so that lists do too."""
    return int(min(SAMPLE // 2, max(64, 2.5 * n**0.5)))


def unit(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, and which rows have one. Rows must be of one length."""
    x = np.array(vectors, dtype=np.float64)
    if not x.size:
        return x, np.zeros(len(x), dtype=bool)
    largest = np.abs(x).max(axis=1)
    good = np.isfinite(largest) & (largest > 0)
    x[good] /= largest[good, None]
    x[good] /= np.sqrt((x[good] * x[good]).sum(axis=1))[:, None]
    return x, good


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first among the sampled unit vectors: spread over the data, the same on every run."""
    if not len(sample):
        return sample
    picked, near = [0], sample @ sample[0]
    while len(picked) < min(count, len(sample)):
        k = int(near.argmin())
        if near[k] > 1 - 1e-9:
            break
        picked.append(k)
        near = np.maximum(near, sample @ sample[k])
    return sample[picked]


def _candidates(left: np.ndarray, right: np.ndarray, hot: np.ndarray, pivot: int, second: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of permutations that share SHARED pivots and are to be verified in the list of `pivot` (split by `second`).

    Shared pivots are counted by one product of memberships; only pairs that share enough are looked at one by one.
    """
    common = np.intersect1d(left, right)

    def members(near: np.ndarray) -> np.ndarray:
        out = np.zeros((len(near), len(common)), dtype=np.float32)
        at = np.minimum(np.searchsorted(common, near), len(common) - 1)
        row, column = np.nonzero(common[at] == near)
        out[row, at[row, column]] = 1
        return out

    if not len(common):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.nonzero(members(left) @ members(right).T >= min(SHARED, left.shape[1]))
    kept = []
    for k in range(0, len(a), CHUNK):
        mine, theirs = left[a[k : k + CHUNK]], right[b[k : k + CHUNK]]
        same = mine[:, :, None] == theirs[:, None, :]
        early = same[:, :PREFIX, :PREFIX].any(axis=2)
        first = mine[:, :PREFIX]
        least = lambda some, of: np.where(some, of, _NONE).min(axis=1)
        small = least(early & ~hot[first], first)
        if second < 0:
            kept.append(small == pivot)
        else:
            other = least(same.any(axis=2) & (mine != pivot), mine)
            kept.append((small == _NONE) & (least(early & hot[first], first) == pivot) & (other == second))
    some = np.concatenate(kept) if kept else np.zeros(0, bool)
    return a[some], b[some]


def _linked(batch: pa.Table, i: int, j: int, limit: float, hot: dict[int, np.ndarray]) -> pa.Table:
    """Links between block i and block j of a list: per row its count of links, and a link to its component here."""
    sides, ids, weight = (batch.column(c).to_numpy() for c in ("mine", "id", "copies"))
    pivot, second, size = (batch.column(c)[0].as_py() for c in ("pivot", "second", "size"))
    n = len(ids)
    near = np.stack(batch.column("near").to_numpy())
    left, right = np.flatnonzero(sides == i), np.flatnonzero(sides == j)
    a, b = _candidates(near[left], near[right], hot[size], pivot, second)
    a, b = left[a], right[b]
    if i == j:
        a, b = a[a < b], b[a < b]
    x, _ = unit(np.stack(batch.column("v").to_numpy()))
    sure = [np.einsum("ij,ij->i", x[a[k : k + CHUNK]], x[b[k : k + CHUNK]]) >= limit for k in range(0, len(a), CHUNK)]
    if sure:
        sure = np.concatenate(sure)
        a, b = a[sure], b[sure]
    links, root = np.zeros(n, np.int64), np.arange(n)
    np.add.at(links, a, weight[b])
    np.add.at(links, b, weight[a])
    while True:  # the smallest member that links within the group reach
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
        if (before == root).all():
            break
    some = np.flatnonzero(links > 0)
    return pa.table({"id": ids[some], "links": links[some], "to": ids[root[some]]})


def near_duplicates(table: DataFrame, scratch: Scratch, *, limit: float = 0.9, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of `table`."""
    rows = table.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    fine = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = scratch.keep(rows.withColumn("fine", F.coalesce(fine & F.col("id").isNotNull(), F.lit(False))), "rows")
    classes = scratch.keep(rows.where("fine").groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("copies")).withColumn("size", F.size("v")), "classes")
    lengths = {r["size"]: r["n"] for r in classes.groupBy("size").agg(F.count("*").alias("n")).collect()}  # a row per length
    total = max(1, sum(lengths.values()))
    part = F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)) / float(1 << 30)
    # of each length its share of SAMPLE, and 64 rows where that is less
    share = {k: max(SAMPLE / total, 64 / n) for k, n in lengths.items()}
    sample: dict[int, list] = {k: [] for k in lengths}
    if lengths:
        wanted = F.element_at(F.create_map(*[F.lit(x) for kv in share.items() for x in kv]), F.col("size"))
        for r in sorted(classes.where(part < wanted).select("id", "size", "v").collect()):
            sample[r["size"]].append(r["v"])
    pivots = {k: choose_pivots(unit(v)[0], pivot_count(lengths[k])) for k, v in sample.items() if v}
    # a length whose rows all escaped the sample has one pivot, so all its vectors share a list
    pivots |= {k: np.eye(1, k) for k in lengths if k not in pivots}
    shared = table.sparkSession.sparkContext.broadcast(pivots)  # at most SAMPLE vectors, and 64 more for each length

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column("size").to_numpy()
            for k in np.unique(sizes).tolist():
                part = b.filter(pa.array(sizes == k))
                x, _ = unit(np.stack(part.column("v").to_numpy(zero_copy_only=False)))
                near = np.argsort(-(x @ shared.value[k].T), axis=1, kind="stable")[:, :NEAREST].astype(np.int32)
                at = np.arange(len(near) + 1, dtype=np.int32) * near.shape[1]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "copies", "v", "size")), pa.ListArray.from_arrays(pa.array(at), pa.array(near.ravel()))], ["id", "copies", "v", "size", "near"])

    near = scratch.keep(classes.select("id", "copies", "v", "size").mapInArrow(describe, "id long, copies long, v array<double>, size int, near array<int>"), "near")
    early = near.select("size", F.explode(F.slice("near", 1, PREFIX)).alias("pivot")).groupBy("size", "pivot").agg(F.count("*").alias("n"))
    hot = {k: np.zeros(len(v), dtype=bool) for k, v in pivots.items()}
    for r in early.where(F.col("n") > HOT).collect():  # pivots at most
        hot[r["size"]][r["pivot"]] = len(pivots[r["size"]]) > 1  # a lone pivot has no second one to split by
    split = F.create_map(*[x for k, v in hot.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in np.flatnonzero(v).tolist()]).cast("array<int>"))]) if hot else None
    is_hot = F.array_contains(F.element_at(split, F.col("size")), F.col("pivot")) if hot else F.lit(False)
    alone, others = F.array(F.lit(-1)), F.filter("near", lambda x: x != F.col("pivot"))
    posted = near.withColumn("pivot", F.explode(F.slice("near", 1, PREFIX))).withColumn("second", F.explode(F.when(is_hot, others).otherwise(alone)))
    lists = scratch.keep(posted.groupBy("size", "pivot", "second").agg(F.count("*").alias("n")).where("n > 1").select("size", "pivot", "second", F.ceil(F.col("n") / BLOCK).alias("blocks")), "lists")
    spread = posted.join(lists, ["size", "pivot", "second"]).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    spread = spread.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other")).drop("other", "blocks")

    def group(key: tuple, batch: pa.Table) -> pa.Table:
        return _linked(batch, key[3].as_py(), key[4].as_py(), limit, hot)

    found = scratch.keep(spread.groupBy("size", "pivot", "second", "i", "j").applyInArrow(group, "id long, links long, to long"), "found")
    parts = components(found.select(F.col("id").alias("a"), F.col("to").alias("b")), scratch)
    named = classes.join(found.groupBy("id").agg(F.sum("links").alias("links")), "id", "left").join(parts, "id", "left")
    named = scratch.keep(named.select("v", F.coalesce("component", "id").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")), "named")
    out = rows.join(named.withColumnRenamed("v", "w"), F.col("v").eqNullSafe(F.col("w")) & F.col("fine"), "left")
    out = out.select(F.col("id").alias(id_column), F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.col(id_column) == F.col("component_id"))
