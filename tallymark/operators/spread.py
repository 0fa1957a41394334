"""Rows dealt over all cores before work that costs more than reading them."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(rows: DataFrame, *key: str) -> DataFrame:
    """The rows in at least two tasks a core, those of one `key` in one task.

    A narrow file is read by a task for each of its row groups, up to a million rows, and small shuffles are joined into
    few tasks; names and lines of such rows then take their patterns on one core.
    """
    spark = rows.sparkSession
    return rows.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *key)
