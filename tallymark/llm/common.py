"""Helpers that the training-data operators share: scratch tables and bounded slices of Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: space, tab, line feed, vertical tab, form feed, carriage return.
WORD_GAPS = " \t\n\x0b\x0c\r"

#: ASCII upper case to lower case, as the word contracts ask.
LOWER = {c: c + 32 for c in range(65, 91)}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A folder of our own serves only where both are one process."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if not own:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that the driver and all executors share (master {master})")
        own = tempfile.mkdtemp(prefix="tallymark-")
        spark.conf.set("spark.checkpoint.dir", own)
    return own.rstrip("/")


class Scratch:
    """Written tables that cut lineage. They outlive executors, unlike a local checkpoint."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, tag: str, files: int | None = None) -> DataFrame:
        """Writes df and reads it again; `files` bounds the tasks that write a table known to be small."""
        if files:
            df = df.coalesce(files)
        path = f"{self.root}/{tag}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", "zstd").parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._scratch_path = path
        return kept

    def drop(self, *frames: DataFrame) -> None:
        """Deletes kept tables that no later plan reads."""
        jvm = self.spark._jvm
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000):
    """Arrow batches of at most so many rows for what is run meanwhile, where rows are whole texts and memory is short."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan: file bytes for a scan. Sets partition counts only, never results."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the strings of one column take about `limit` bytes each, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        total = batch.column(at).nbytes
        if total <= limit:
            yield batch
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
        start = size = 0
        for i, n in enumerate(sizes):
            if size and size + n > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        yield batch.slice(start)


def crc_of_id(column: str = "doc_id"):
    """crc32 of a number written as text: the contracts' way to tell training rows from held-out ones."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def split_unique(texts: pa.Array, gap: str | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct tokens, the token of each place, and the count of tokens of each text (null: none).

    `gap` None splits at runs of ASCII white space and gives no empty token; else the text is split at every `gap`.
    """
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    split = pc.ascii_split_whitespace(texts) if gap is None else pc.split_pattern(texts, gap)
    counts = np.diff(split.offsets.to_numpy()).astype(np.int64)
    coded = split.flatten().dictionary_encode()
    index, unique = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    if gap is None and "" in unique:
        empty = index == unique.index("")
        upto = np.r_[0, np.cumsum(empty)]
        ends = np.cumsum(counts)
        counts = counts - (upto[ends] - upto[ends - counts])
        index = index[~empty]
    return unique, index, counts
