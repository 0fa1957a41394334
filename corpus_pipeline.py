"""The training-data pipeline: each stage's output is written as Parquet and read again by the next.

Rows that share a doc_id are one document, repeated rows among them: all of its rows stay or go together. Nulls: a null
text has no language and goes in the first stage; a document with a null doc_id cannot be named in a group and stays.
Empty tables give empty stages; further columns, whatever their names, pass all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import decontam, langid, minhash, pieces
from tallymark.llm.common import Scratch, table
from tallymark.llm.queries import MODEL, vocabulary

#: No stage is expressible in SQL. tests/llm/test_pipeline.py holds each stage, on what its predecessor kept, against a plain
#: version: all pairs for near copies, all items in all texts for leaks, the library for ids; of the first stage, that
#: exactly the documents go whose language is undetermined or whose score is under its limit.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language is identified: without a letter, or with a score under 0.5."""
    model = langid.fit(docs, F.lit(True), pieces.codec(vocabulary(MODEL)).pieces)
    return langid.identified(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one with the smallest id, of each group of near copies (five words, 0.8)."""
    groups = minhash.near_duplicates(docs, Scratch(spark, "pipeline"))
    copies = groups.groupBy(F.col("doc_id").alias("copy")).agg(F.max("kept").alias("kept")).where("not kept").select("copy")
    return docs.join(copies, docs["doc_id"].cast("long") == copies["copy"], "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark item stands."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, count of ids and digests of ids and decoded text."""
    return pieces.digests(docs, vocabulary(MODEL))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("sentencepiece", sentencepiece)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "stages"), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
