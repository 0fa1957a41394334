import math

import duckdb
import pytest

from tallymark import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in catalog.TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(x) for x in r) for r in df.select(columns).collect()), key=str)
    if name in catalog.oracle_sql():
        want = duck.sql(catalog.oracle_sql()[name])
        assert sorted(want.columns) == columns
        at = [want.columns.index(c) for c in columns]
        assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)
    else:
        assert got


WHOLE = "strip_suffixes trigram_block_topk trigram_similarity candidate_union resolve_full resolve_exact verdicts term_gaps term_overlaps".split()


def test_whole_tables(spark):
    """No query reads part of its table by id. sf0.01 has 1,500 customers; the SQL holds there too."""
    sf = "/root/testdata/sf0.01"
    c = duckdb.connect()
    for t in catalog.TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = {n: (d := catalog.queries()[n](spark, sf)).select(sorted(d.columns)).collect() for n in WHOLE}
    for n in set(WHOLE) & set(catalog.oracle_sql()):
        want = c.sql(catalog.oracle_sql()[n])
        at = [want.columns.index(x) for x in sorted(want.columns)]
        assert sorted((tuple(plain(x) for x in r) for r in got[n]), key=str) == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str), n
    names = c.sql(f"select count(*) from ({catalog.NAMES}) n").fetchall()[0][0]
    assert len(got["strip_suffixes"]) == names and len(got["verdicts"]) == names > 1000
    for n in WHOLE[1:6]:
        assert max(r.query_id for r in got[n]) > 1400, n
    held = {t for (t,) in c.sql(f"select distinct term from (select {catalog._TERMS} from documents) d").fetchall()}
    assert not {r.term for r in got["term_gaps"]} & held and {r.term for r in got["term_overlaps"]} <= held
    assert catalog.queries()["keyword_coverage"](spark, SF).select("resume_id").distinct().count() == spark.read.parquet(f"{SF}/part.parquet").count()


def test_stream_matches_batch(spark, tmp_path):
    from tallymark.streaming import usage

    rows = spark.read.parquet(f"{SF}/events.parquet").selectExpr("cast(ts as timestamp) as ts", "user_id", "event_type as name")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = usage.daily_counts(stream).writeStream.outputMode("complete").format("memory").queryName("daily").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("daily").collect()) == sorted(usage.daily_counts(rows).collect())
