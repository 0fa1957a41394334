"""Caches, dedupes and limits as streams: several batches, late and repeated rows, against what the batch form says."""

import datetime

import pytest

from tallymark.streaming import caches, usage

START = datetime.datetime(2024, 5, 1)


def at(minutes):
    return START + datetime.timedelta(minutes=minutes)


def streamed(spark, tmp_path, schema, batches, plan, mode="append"):
    """The rows that a plan gives over batches that come one after the other."""
    source = tmp_path / "in"
    source.mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = plan(stream).writeStream.outputMode(mode).format("memory").queryName("told").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"one{i}"))
            part = next((tmp_path / f"one{i}").glob("*.parquet"))
            part.rename(source / f"{i}.parquet")
            query.processAllAvailable()
        return spark.table("told").collect()
    finally:
        query.stop()


LOOKUP = "key string, ts timestamp, write boolean, payload string"


def test_entries_expire(spark, tmp_path):
    batches = [
        [("a", at(0), True, "one"), ("a", at(1), False, None), ("b", at(1), False, None)],
        [("a", at(50), False, None), ("b", at(51), True, "two"), ("b", at(51), False, None)],
        [("a", at(60), False, None), ("a", at(61), False, None), ("b", at(70), True, "three"), ("b", at(111), False, None)],
        [("a", at(500), False, None), ("b", at(131), False, None), ("b", at(500), True, "four")],
        [("b", at(510), False, None), ("a", at(501), True, "five"), ("a", at(502), False, None)],
    ]
    got = streamed(spark, tmp_path, LOOKUP, batches, lambda rows: caches.lookups(rows, ttl=3600))
    want = caches.lookups(spark.createDataFrame([r for b in batches for r in b], LOOKUP), ttl=3600).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)
    told = {(r.key, r.ts): (r.hit, r.payload) for r in want}
    assert told["a", at(60)] == (True, "one") and told["a", at(61)] == (False, None) and told["b", at(51)] == (True, "two")
    assert told["b", at(1)] == (False, None) and told["b", at(131)] == (False, None) and told["b", at(510)] == (True, "four")


RESULT = "session string, generation long, ts timestamp, payload string"


def test_late_generations_are_dropped(spark, tmp_path):
    batches = [
        [("s", 1, at(0), "a"), ("s", 2, at(1), "b"), ("t", 5, at(1), "x")],
        [("s", 1, at(2), "late"), ("s", 3, at(3), "c"), ("s", 2, at(4), "late too"), ("t", 5, at(4), "again")],
        [("s", 3, at(5), "same"), ("t", 4, at(6), "late"), ("u", 1, at(6), "new")],
    ]
    got = streamed(spark, tmp_path, RESULT, batches, caches.current)
    want = caches.current(spark.createDataFrame([r for b in batches for r in b], RESULT)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert {r.payload for r in got} == {"a", "b", "x", "c", "again", "same", "new"}


def test_a_key_is_rendered_once(spark, tmp_path):
    schema = "session string, key string, ts timestamp"
    batches = [[("s", "k", at(0)), ("s", "k", at(1)), ("t", "k", at(0))], [("s", "k", at(5)), ("s", "m", at(5))]]
    got = streamed(spark, tmp_path, schema, batches, caches.rendered)
    assert sorted((r.session, r.key) for r in got) == [("s", "k"), ("s", "m"), ("t", "k")]
    once = caches.rendered(spark.createDataFrame([r for b in batches for r in b], schema)).collect()
    assert sorted(map(tuple, once)) == [("s", "k", at(0)), ("s", "m", at(5)), ("t", "k", at(0))]


EVENT = "ts timestamp, user_id long, name string"


@pytest.mark.parametrize("name", ["over_limit", "sessions"])
def test_limits_and_sessions_with_late_rows(spark, tmp_path, name):
    """Closed windows are told once; rows within the watermark's delay still count, later ones do not."""
    rows = [(at(m), u, "x") for m, u in ((0, 1), (1, 1), (2, 1), (2, 2), (63, 1))]
    late = [(at(3), 1, "x"), (at(64), 2, "x"), (at(400), 3, "x")]
    too_late = [(at(4), 1, "x"), (at(900), 3, "x")]
    plan = {"over_limit": lambda r: usage.over_limit(r, "1 hour", 2, late="1 hour"), "sessions": lambda r: usage.sessions(r, "30 minutes", late="1 hour")}[name]
    got = streamed(spark, tmp_path, EVENT, [rows, late, too_late, [(at(2000), 9, "x")]], plan)
    want = plan(spark.createDataFrame([*rows, *late, (at(900), 3, "x")], EVENT)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want
