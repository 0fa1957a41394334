"""Long-format facts: natural-key upserts, aggregation with provenance, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .resolve import checked

KEY = ["company_id", "country", "year", "metric", "source_id"]


def upsert(old: DataFrame, new: DataFrame, key: list[str] = KEY) -> DataFrame:
    """The later row of each natural key; null years are one key. Rows of `new` with one key are summed first."""
    rest = [c for c in old.columns if c not in key]
    new = new.groupBy(*key).agg(F.sum("value").alias("value"), *[F.max(c).alias(c) for c in rest if c != "value"])
    both = old.withColumn("_late", F.lit(0)).unionByName(new.select(old.columns).withColumn("_late", F.lit(1)))
    return both.groupBy(*key).agg(F.max_by(F.struct(*rest), "_late").alias("_last")).select(*key, "_last.*")


def totals(stats: DataFrame) -> DataFrame:
    return stats.groupBy("company_id", "country", "metric").agg(F.round(F.sum("value"), 2).alias("value"))


def years(stats: DataFrame) -> DataFrame:
    """First, last and count of years with figures; a missing year marks a register without years."""
    return stats.groupBy("company_id", "country").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count_distinct("year").alias("n_years"))


def sources(stats: DataFrame) -> DataFrame:
    return stats.groupBy("company_id", "country", "source_id").agg(F.max("published_date").alias("published_date"))


def records(stats: DataFrame) -> DataFrame:
    """One nested record per company and country: sums by metric to the cent, years ascending, sources by id.

    Rows are summed by metric, year and source before they meet, so a company holds as many rows as it has of those.
    """
    part = stats.groupBy("company_id", "country", "metric", "year", "source_id").agg(F.sum("value").alias("value"), F.max("published_date").alias("published_date"))
    each = part.groupBy("company_id", "country").agg(
        F.collect_list(F.struct("metric", "value")).alias("m"),
        F.sort_array(F.collect_set("year")).alias("years"),
        F.collect_list(F.struct("source_id", "published_date")).alias("s"),
    )

    def by(entries: str, key: str, value):
        keys = F.array_sort(F.array_distinct(F.transform(entries, lambda e: e[key])))
        return F.transform(keys, lambda k: value(k, F.filter(entries, lambda e: e[key] == k)))

    kind = part.schema["value"].dataType
    total = lambda own: F.round(F.aggregate(own, F.lit(0).cast(kind), lambda x, e: (x + F.coalesce(e["value"], F.lit(0).cast(kind))).cast(kind)), 2)
    metrics = F.map_from_entries(by("m", "metric", lambda k, own: F.struct(k.alias("metric"), total(own).alias("value"))))
    sources = by("s", "source_id", lambda k, own: F.struct(k.alias("source_id"), F.array_max(F.transform(own, lambda e: e["published_date"])).alias("published_date")))
    return each.select("company_id", "country", metrics.alias("metrics"), "years", sources.alias("sources"))


def verdicts(queries: DataFrame, matches: DataFrame, stats: DataFrame, registry: DataFrame) -> DataFrame:
    """One row per query: `verified` with its match and records, or `no_record`; no negative finding from missing data.

    queries: query_id, name, country; matches: as `resolve` gives them, with canonical_name; stats: facts; registry: the
    sources (id, label, publisher, url). A query that names a supported country gets records of that country, any other
    those of all; `countries_checked` says which. A company without a fact is no record; a source that the registry does
    not hold fails the query, as a figure without provenance must not be shown.
    """
    asked = queries.select("query_id", F.col("name").alias("queried_name"), checked(F.col("country")).alias("countries_checked"))
    named = registry.select(F.col("id").alias("source_id"), "label", "publisher", "url")
    shown = records(stats)
    flat = shown.select("company_id", "country", "metrics", "years", F.explode("sources").alias("s")).select("company_id", "country", "metrics", "years", "s.*").join(named, "source_id", "left")
    sure = F.when(F.col("label").isNull(), F.raise_error(F.concat(F.lit("unknown source: "), F.coalesce("source_id", F.lit("null"))))).otherwise(F.col("label"))
    entry = F.struct(F.col("source_id").alias("id"), sure.alias("label"), "publisher", "published_date", "url")
    cited = flat.groupBy("company_id", "country").agg(F.first("metrics").alias("metrics"), F.first("years").alias("years"), F.sort_array(F.collect_list(entry)).alias("sources"))
    held = cited.groupBy("company_id").agg(F.collect_list(F.struct("country", "metrics", "years", "sources")).alias("records"))  # a row a country
    rows = asked.join(matches, "query_id", "left").join(held, "company_id", "left")
    verified = F.col("records").isNotNull()
    ordered = F.array_sort("records", lambda x, y: F.when(x["country"] < y["country"], -1).when(x["country"] > y["country"], 1).otherwise(0))
    match = F.struct("company_id", "canonical_name", "matched_name", "score", "confidence", "method", "warnings")
    return rows.select(
        "query_id", "queried_name", F.when(verified, "verified").otherwise("no_record").alias("kind"), "countries_checked", F.when(verified, match).alias("match"),
        F.when(verified, F.filter(ordered, lambda r: F.array_contains("countries_checked", r["country"]))).alias("records"),
    )


def first_of(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("_first")).select(*key, "_first.*")


def oldest_beyond(entries: DataFrame, limit: int = 500, share: float = 0.25) -> DataFrame:
    """Cache eviction: the oldest quarter of `limit` goes once a store holds `limit` entries; its keys are distinct.

    The rank is only asked up to that quarter, so each task sends its oldest entries of a store and no more; what stays
    is found by the newest evicted entry, not by ranking a whole store in one task.
    """
    age, quarter = F.struct("stored_at", "key"), int(-(-limit * share // 1))
    ranked = entries.select("store", age.alias("age")).withColumn("r", F.row_number().over(Window.partitionBy("store").orderBy("age")))
    edges = ranked.where(F.col("r") <= quarter).groupBy("store").agg(F.max("age").alias("edge"))
    full = entries.groupBy("store").agg(F.count("*").alias("n")).where(F.col("n") >= limit)
    edges = edges.join(full, edges["store"].eqNullSafe(full["store"]), "left_semi").withColumnRenamed("store", "_store")
    return entries.join(edges, entries["store"].eqNullSafe(edges["_store"]), "left").where(F.col("edge").isNull() | (age > F.col("edge"))).drop("_store", "edge")
