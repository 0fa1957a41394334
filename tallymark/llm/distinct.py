"""Distinct counts and their set algebra from bottom-k sketches, beside exact counts of the same sets.

A sketch is the sorted array of the `k` smallest 64-bit hashes of a set. Sketches merge by union and truncation. The
union's k smallest hashes are a uniform sample of the union, so the share of them that is in both sets, or only in one,
scales the estimated size of the union; a score interval of the binomial share and the error of the size bound it.

Nothing that grows with the rows meets in one task: a member counts once for each set, hot members and sets are summed
before they are shuffled, and a set sends only hashes below its own cutoff, fewer than about 2k of them, to its sketch.

Defined results: rows with a null member, set name or time are not used; an empty table gives no rows; repeated rows
count once; a set that is empty on a day has the size 0 and an empty sketch; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Hashes in a sketch; calendar days in a window; days by which the second window lags; standard errors of the bounds.
K, DAYS, LAG, Z = 512, 7, 1, 3.0
#: Rows of a table of cutoffs (one for each set and day) up to which it is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000


def members(rows: DataFrame, member: str, name: str, at: str) -> DataFrame:
    """Distinct (member, name, day) of rows that have all three; day counts from 1970-01-01."""
    day = F.unix_date(F.to_date(at)).cast("long")
    used = rows.select(F.col(member).alias("member"), F.col(name).cast("string").alias("name"), day.alias("day"))
    return used.where("member is not null and name is not null and day is not null").distinct()


def _unit(h: Column) -> Column:
    """A signed hash as a number from 0 to 1, in the hashes' order."""
    return (h.cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)


def sketches(rows: DataFrame, scratch: Scratch, k: int = K) -> DataFrame:
    """(name, day, sketch): the k smallest hashes of the members of each name and day.

    Hashes are counted by how often their range was halved; the deepest level that still holds k of a set's hashes is its
    cutoff. The counts are a few rows a set, and what passes the cutoff is k to about 2k hashes, however large the set.
    """
    h = F.xxhash64("member")
    level = F.least(F.floor(-F.log2(_unit(h) + F.lit(2.0**-62))), F.lit(61)).cast("int")
    hashed = rows.select("name", "day", h.alias("h"), level.alias("level"))
    depth = Window.partitionBy("name", "day").orderBy(F.desc("level"))
    levels = hashed.groupBy("name", "day", "level").agg(F.count("*").alias("n")).withColumn("n", F.sum("n").over(depth))
    deepest = F.coalesce(F.max(F.when(F.col("n") >= k, F.col("level"))), F.lit(0))
    cutoffs = scratch.keep(levels.groupBy("name", "day").agg(deepest.alias("cutoff")), "cutoffs")
    if cutoffs.count() <= BROADCAST_ROWS:
        cutoffs = F.broadcast(cutoffs)
    low = hashed.join(cutoffs, ["name", "day"]).where("level >= cutoff")
    return low.groupBy("name", "day").agg(F.slice(F.sort_array(F.collect_set("h")), 1, k).alias("sketch"))


def windows(daily: DataFrame, days: int = DAYS, lag: int = 0, k: int = K) -> DataFrame:
    """(name, day, sketch) of the `days` calendar days that end `lag` days before each day: daily sketches, merged."""
    ahead = daily.select("name", F.explode(F.sequence(F.col("day") + lag, F.col("day") + lag + days - 1)).alias("day"), "sketch")
    union = F.sort_array(F.array_distinct(F.flatten(F.collect_list("sketch"))))  # at most days * k hashes
    return ahead.groupBy("name", "day").agg(F.slice(union, 1, k).alias("sketch"))


def algebra(a: Column, b: Column, k: int = K, z: float = Z) -> Column:
    """struct of est_union, est_both, est_only_a and their err_, from two sketches alone.

    A union of fewer than k hashes is complete, so its figures are exact and their errors 0. Else the k-th smallest
    hash of the union gives its size, and a Wilson interval of each share, times the interval of the size, the error.
    """
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    none = F.lit(0.0)

    def figures(u: Column) -> Column:
        full = F.size(u) >= k
        size = F.when(full, F.lit(k - 1.0) / F.greatest(_unit(F.element_at(u, -1)), F.lit(2.0**-64))).otherwise(F.size(u).cast("double"))
        slack = z / (k - 2) ** 0.5
        in_a = F.array_intersect(u, a)
        both = F.size(F.array_intersect(in_a, b)).cast("double")
        only = F.size(in_a).cast("double") - both

        def scaled(m: Column) -> Column:
            return F.when(full, size * m / k).otherwise(m)

        def error(m: Column) -> Column:
            share = m / k
            centre, half = (share + z * z / (2 * k)) / (1 + z * z / k), F.sqrt(share * (1 - share) / k + z * z / (4.0 * k * k)) * (z / (1 + z * z / k))
            most, least = size * (1 + slack) * F.least(centre + half, F.lit(1.0)), size * (1 - slack) * F.greatest(centre - half, none)
            return F.when(full, F.greatest(most - scaled(m), scaled(m) - least)).otherwise(none)

        return F.struct(
            size.alias("est_union"), scaled(both).alias("est_both"), scaled(only).alias("est_only_a"),
            F.when(full, size * slack).otherwise(none).alias("err_union"), error(both).alias("err_both"), error(only).alias("err_only_a"),
        )

    # the union is one array however often it is read
    return F.get(F.transform(F.array(union), figures), F.lit(0))


def exact_pairs(rows: DataFrame, days: int = DAYS, lag: int = LAG) -> tuple[DataFrame, DataFrame]:
    """((name, day, n_a, n_b), (day, kind_a, kind_b, n_both)): exact sizes of both windows and of their intersections.

    Rows are dealt by member once. A member's rows are at most names * days, as `rows` are distinct, so a hot member is
    no hot task; its pairs of one day are pairs of names, of which there are few.
    """
    reach = F.sequence(F.col("day"), F.col("day") + max(days, days + lag) - 1)
    ahead = rows.repartition("member").select("member", "name", "day", F.explode(reach).alias("at"))
    in_a, in_b = F.col("at") - F.col("day") < days, F.col("at") - F.col("day") >= lag
    seen = ahead.groupBy("member", "at", "name").agg(F.bool_or(in_a).alias("a"), F.bool_or(in_b).alias("b"))
    of_day = seen.groupBy("member", "at").agg(F.collect_list(F.when(F.col("a"), F.col("name"))).alias("as"), F.collect_list(F.when(F.col("b"), F.col("name"))).alias("bs"))
    pairs = of_day.select(F.col("at").alias("day"), F.explode("as").alias("kind_a"), "bs").select("day", "kind_a", F.explode("bs").alias("kind_b"))
    sizes = seen.groupBy("name", F.col("at").alias("day")).agg(F.count_if("a").alias("n_a"), F.count_if("b").alias("n_b"))
    return sizes, pairs.groupBy("day", "kind_a", "kind_b").agg(F.count("*").alias("n_both"))


def overlaps(rows: DataFrame, scratch: Scratch, *, member: str, name: str, at: str, days: int = DAYS, lag: int = LAG, k: int = K) -> DataFrame:
    """One row for each used day and ordered pair of names found anywhere: exact and estimated union, both, only_a.

    A is the first name's members in the `days` days that end with the day, B the second's in those that end `lag` days
    before it.
    """
    used = scratch.keep(members(rows, member, name, at), "members")
    sizes, both = exact_pairs(used, days, lag)
    daily = scratch.keep(sketches(used, scratch, k), "daily")
    names = daily.agg(F.sort_array(F.collect_set("name")).alias("names"))  # one row: the names, not their members
    grid = daily.select("day").distinct().crossJoin(F.broadcast(names))
    grid = grid.select("day", F.explode("names").alias("kind_a"), "names").select("day", "kind_a", F.explode("names").alias("kind_b"))

    def side(of: DataFrame, kind: str, *columns: Column) -> DataFrame:
        return of.select("day", F.col("name").alias(kind), *columns)

    sizes = scratch.keep(sizes, "sizes")
    found = grid.join(side(sizes, "kind_a", F.col("n_a")), ["day", "kind_a"], "left").join(side(sizes, "kind_b", F.col("n_b")), ["day", "kind_b"], "left")
    found = found.join(both, ["day", "kind_a", "kind_b"], "left")
    found = found.join(side(windows(daily, days, 0, k), "kind_a", F.col("sketch").alias("a")), ["day", "kind_a"], "left")
    found = found.join(side(windows(daily, days, lag, k), "kind_b", F.col("sketch").alias("b")), ["day", "kind_b"], "left")
    empty, zero = F.array().cast("array<bigint>"), F.lit(0).cast("long")
    n_a, n_b, n_both = (F.coalesce(c, zero) for c in ("n_a", "n_b", "n_both"))
    estimates = algebra(F.coalesce("a", empty), F.coalesce("b", empty), k).alias("e")
    found = found.select("day", "kind_a", "kind_b", (n_a + n_b - n_both).alias("n_union"), n_both.alias("n_both"), (n_a - n_both).alias("n_only_a"), estimates)
    return found.select("day", "kind_a", "kind_b", "n_union", "n_both", "n_only_a", "e.*")
