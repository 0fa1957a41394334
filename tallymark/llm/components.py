"""Connected components of a distributed edge table, and bounded work on large groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) for every id on an edge (a, b): the smallest id that links reach.

    Alternates large-star and small-star steps: every id hands its larger neighbours, then its smaller ones, to the
    smallest id it knows. The rounds grow with the logarithm of a component's size, and each round is two
    aggregations. Neighbours are never gathered into one row: the minimum per id is joined back to the edges, so a hub
    with a third of all links is a sum of many partial minima.
    """
    now = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    state = _state(now)
    files = max(8, state[0] // 50_000)  # of tables that are no larger than the edges
    while state[0]:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        # minima are written, so that both sides of the joins are shuffled and Spark can split a hub's partition
        least = scratch.keep(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m")), "least", files)
        large = scratch.keep(now.select(F.col("lo").alias("u"), "hi").join(least, "u").select("hi", F.col("m").alias("lo")).distinct(), "large", files)
        least_of = scratch.keep(large.groupBy("hi").agg(F.min("lo").alias("m")), "least", files)
        joined = large.join(least_of, "hi")
        small = joined.select(F.col("lo").alias("x"), F.col("m").alias("y")).unionByName(least_of.select(F.col("hi").alias("x"), F.col("m").alias("y")))
        after = scratch.keep(small.where("x <> y").select(F.col("x").alias("hi"), F.col("y").alias("lo")).distinct(), "edges", files)
        before, state = state, _state(after)
        scratch.drop(now, least, large, least_of)
        now = after
        if state == before:
            break
    # every id now has one edge, to its component's smallest id
    return now.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionByName(now.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
