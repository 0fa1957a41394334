"""Line dedup: lines whose key stands in many documents go, by levelled sorted runs of line hashes.

A run is a written table of (hash, documents), bucketed and sorted by hash. A batch of documents counts its own line
hashes, drops by a merge anti-join those that a run already knows as frequent, and becomes a run of the lowest level. As
soon as a level holds `fan` runs they are merged, counts summed, into one run of the next level. So a hash is rewritten
once a level, a batch never touches the documents of others, and a run's buckets meet the batch's without a shuffle.

Defined results: a row of the table is a document, repeated rows and equal or null doc_ids count as documents each; a
null or empty text is one empty line; blank lines have the empty key and stay; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, WORD_GAPS, Scratch

#: Documents that must hold a line; code points of the shortest key; batches of a whole table; runs of a level.
AT_LEAST, SHORTEST, BATCHES, FAN = 10, 1, 4, 2


def key_of(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WORD_GAPS)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hashes(text: Column, shortest: int = SHORTEST) -> Column:
    """Distinct 128-bit hashes of a text's line keys."""
    keys = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), key_of), lambda k: F.char_length(k) >= shortest)
    return F.transform(F.array_distinct(keys), lambda k: F.unhex(F.md5(k.cast("binary"))))


class LineRuns:
    """The levelled runs of line hashes of all batches so far.

    `buckets` is fixed for the runs' lifetime; runs are tables in the shared folder, so they outlive executors.
    """

    def __init__(self, spark: SparkSession, scratch: Scratch, *, at_least: int = AT_LEAST, fan: int = FAN, buckets: int | None = None):
        self.spark, self.scratch, self.at_least, self.fan = spark, scratch, at_least, fan
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []

    def _write(self, run: DataFrame, level: int) -> DataFrame:
        name = f"line_run_{level}_{uuid.uuid4().hex}"
        path = f"{self.scratch.root}/{name}"
        run.write.bucketBy(self.buckets, "h").sortBy("h").option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
        kept = self.spark.table(name)
        kept._scratch_path, kept._table = path, name
        return kept

    def _drop(self, runs: list[DataFrame]) -> None:
        for run in runs:
            self.spark.sql(f"drop table {run._table}")
        self.scratch.drop(*runs)

    def close(self) -> None:
        """Drops all runs."""
        self._drop(self.runs())
        self.levels = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def unsettled(self, counts: DataFrame) -> DataFrame:
        """The hashes of (h, n) that no run knows to be in `at_least` documents: with 1, those not seen before."""
        for run in self.runs():
            counts = counts.join(run.where(F.col("n") >= self.at_least).select("h").hint("merge"), "h", "left_anti")
        return counts

    def add(self, hashed: DataFrame) -> None:
        """Adds a batch: `hashed` has a row of h for each document and distinct line of it."""
        counts = hashed.groupBy("h").agg(F.count("*").alias("n"))
        self._push(self._write(self.unsettled(counts), 0), 0)

    def _push(self, run: DataFrame, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fan:
            full, self.levels[level] = self.levels[level], []
            merged = self._write(self.merged(full), level + 1)
            self._drop(full)
            self._push(merged, level + 1)

    def merged(self, runs: list[DataFrame]) -> DataFrame:
        """(h, n) of several runs as one, counts summed: a merge join of sorted buckets, each hash once on either side."""
        first, *others = runs
        for run in others:
            side = run.select("h", F.col("n").alias("more")).hint("merge")
            first = first.join(side, "h", "full").select("h", (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n"))
        return first

    def frequent(self) -> DataFrame:
        """(h) of lines in `at_least` documents or more, over all runs.

        A hash that an earlier run had settled is not counted by later ones, so a sum can only be short of what is
        already enough.
        """
        return self.merged(self.runs()).where(F.col("n") >= self.at_least).select("h")


def _without(text: str | None, gone: list | None, shortest: int) -> tuple[str, int]:
    """The text without lines whose key's hash is in `gone`, and how many those are."""
    text = text or ""
    if gone is None:
        return text, 0
    lines, hits = text.split("\n"), set(gone)

    def stays(line: str) -> bool:
        key = line.strip(WORD_GAPS).translate(LOWER)
        return len(key) < shortest or hashlib.md5(key.encode()).digest() not in hits

    kept = [line for line in lines if stays(line)]
    return "\n".join(kept), len(lines) - len(kept)


def drop_repeated(docs: DataFrame, scratch: Scratch, *, at_least: int = AT_LEAST, shortest: int = SHORTEST, batches: int = BATCHES, fan: int = FAN) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): every document without the lines whose key stands in `at_least` documents.

    A document's text meets only its own frequent hashes. Those are gathered by doc_id: a hash is frequent wherever it
    stands, so rows that share a doc_id may share the hashes of all of them.
    """
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lot = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("lot")
    hashed = scratch.keep(rows.select("doc_id", lot, F.explode(hashes(F.col("text"), shortest)).alias("h")), "lines")
    store = LineRuns(docs.sparkSession, scratch, at_least=at_least, fan=fan)
    for i in range(batches):
        store.add(hashed.where(F.col("lot") == i).select("h"))
    frequent = scratch.keep(store.frequent(), "frequent")
    store.close()
    hits = hashed.join(frequent, "h", "left_semi").groupBy(F.col("doc_id").alias("of")).agg(F.collect_set("h").alias("gone"))
    joined = rows.join(hits, rows["doc_id"].eqNullSafe(hits["of"]), "left")

    @F.pandas_udf("kept string, n long")
    def without(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, gone in batches:
            yield pd.DataFrame([_without(t, g, shortest) for t, g in zip(text, gone, strict=True)], columns=["kept", "n"])

    text = F.coalesce("text", F.lit(""))
    n_lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    cut = joined.select("doc_id", n_lines.alias("n_lines"), without("text", "gone").alias("c"))
    return cut.select("doc_id", "n_lines", F.col("c.n").alias("n_dropped"), F.col("c.kept").alias("kept"))
