"""Caches and results of a reader over a batch or a stream of rows: entries that expire, keys rendered once, late results dropped."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.store import TTL


def lookups(rows: DataFrame, ttl: int = TTL, late: str = "10 minutes") -> DataFrame:
    """(key, ts, hit, payload) of each lookup among (key, ts, write, payload): a row with `write` stores its payload.

    A lookup finds the last entry that was stored before it, or at its very time, and no longer than `ttl` seconds ago.
    Of entries of one time the largest payload counts. Rows of a stream are taken in the order of their time within a
    batch; a key's entry is forgotten once the watermark is past its end.
    """
    if rows.isStreaming:
        return _lookups_of_stream(rows, ttl, late)
    last = Window.partitionBy("key").orderBy("ts", F.desc("write"), "payload").rowsBetween(Window.unboundedPreceding, -1)
    entry = F.last(F.when(F.col("write"), F.struct("ts", "payload")), ignorenulls=True).over(last)
    found = rows.withColumn("entry", entry).where("not write")
    hit = F.coalesce(F.col("ts") <= F.col("entry.ts") + F.make_dt_interval(secs=F.lit(ttl)), F.lit(False))
    return found.select("key", "ts", hit.alias("hit"), F.when(hit, F.col("entry.payload")).alias("payload"))


def _lookups_of_stream(rows: DataFrame, ttl: int, late: str) -> DataFrame:
    age = pd.Timedelta(seconds=ttl)

    def each(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        entry = state.get if state.exists else None
        stored, payload = (pd.Timestamp(entry[0]), entry[1]) if entry else (None, None)
        out = []
        for r in pd.concat(parts).sort_values(["ts", "write", "payload"], ascending=[True, False, True]).itertuples():
            if r.write:
                stored, payload = (r.ts, r.payload) if stored is None or r.ts >= stored else (stored, payload)
            else:
                hit = stored is not None and stored <= r.ts <= stored + age
                out.append((key[0], r.ts, hit, payload if hit else None))
        if stored is not None:
            state.update((stored.to_pydatetime(), payload))
            state.setTimeoutTimestamp(max(int((stored + age).timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "ts", "hit", "payload"])

    marked = rows.withWatermark("ts", late).select("key", "ts", "write", "payload").groupBy("key")
    return marked.applyInPandasWithState(each, "key string, ts timestamp, hit boolean, payload string", "stored timestamp, payload string", "append", GroupStateTimeout.EventTimeTimeout)


def rendered(rows: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The first row of each (session, key): repeats do not render again. On a stream, repeats within the watermark's delay."""
    if rows.isStreaming:
        return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["session", "key"])
    rest = [c for c in rows.columns if c not in ("session", "key")]
    return rows.groupBy("session", "key").agg(F.min_by(F.struct(*rest), F.struct("ts", *[c for c in rest if c != "ts"])).alias("r")).select("session", "key", "r.*").select(*rows.columns)


def current(rows: DataFrame, late: str = "1 hour") -> DataFrame:
    """Results (session, generation, ts, payload) that are still wanted when they come: a result of an older generation
    than one that its session has had before is dropped. On a stream, a session without rows for `late` is forgotten."""
    if rows.isStreaming:
        return _current_of_stream(rows, late)
    before = Window.partitionBy("session").orderBy("ts", "generation", "payload").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("newest", F.max("generation").over(before)).where("newest is null or generation >= newest").drop("newest")


def _current_of_stream(rows: DataFrame, late: str) -> DataFrame:
    kept = int(pd.Timedelta(late).total_seconds() * 1000)

    def each(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        newest = state.get[0] if state.exists else None
        part = pd.concat(parts).sort_values(["ts", "generation", "payload"])
        before = part["generation"].cummax().shift(fill_value=part["generation"].min() if newest is None else newest)
        before = before if newest is None else before.clip(lower=newest)
        state.update((int(max(part["generation"].max(), newest if newest is not None else part["generation"].max())),))
        state.setTimeoutTimestamp(max(int(part["ts"].max().timestamp() * 1000) + kept, state.getCurrentWatermarkMs() + 1))
        yield part[part["generation"] >= before]

    marked = rows.withWatermark("ts", late).select("session", "generation", "ts", "payload").groupBy("session")
    return marked.applyInPandasWithState(each, "session string, generation long, ts timestamp, payload string", "newest long", "append", GroupStateTimeout.EventTimeTimeout)
