"""What grows with the tables: rows that meet, rows that are shuffled or hashed, and how often a row's pattern is worked out."""

import pyarrow as pa
from pyspark.sql import functions as F

from tallymark import catalog
from tallymark.functions import names
from tallymark.operators import coverage, resolve, store
from tallymark.sources import pages

SF = "/root/testdata/sf0.001"


def steps(df):
    """(node, rows out, rows shuffled) of each step of a query, after it ran, and its rows."""
    execution = df._jdf.queryExecution()
    rows = execution.executedPlan().executeCollect()
    out, todo = [], [execution.executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in name:
            todo.append(node.plan())
            continue
        metric = lambda k: (m := node.metrics().get(k)).get().value() if node.metrics().contains(k) else 0  # noqa: B023, E731
        out.append((name, metric("numOutputRows"), metric("shuffleRecordsWritten")))
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return out, len(rows)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


FIRMS = "company_id long, canonical_name string, normalized_name string, country string"


def same_firms(spark, n):
    firms = spark.range(n).select(F.col("id").alias("company_id"), F.lit("Same Inc").alias("canonical_name"), F.lit("same").alias("normalized_name"), F.lit("US").alias("country"))
    given = spark.range(n).select(F.lit("Same Inc").alias("company_name"), F.lit("US").alias("country"), F.lit("us_petitions").alias("source_id"), F.array(F.lit(" Also Inc"), F.lit("same")).alias("aliases"), F.array(F.concat(F.lit("WWW.s"), "id", F.lit(".example"))).alias("domains"))
    return firms, given


def test_names_are_worked_out_once(spark):
    rows = spark.createDataFrame([("A.B. Works Staffing Inc",), ("Solo",), ("",), (None,), ("Ünï Bank für Ärzte GmbH",)], "name string")
    for f in (names.acronym, names.is_staffing):
        df = rows.select(f(names.normalize(F.col("name"))).alias("x"))
        assert plan(df).count("translate(") == 1
    assert [r.x for r in rows.select(names.acronym(names.normalize(F.col("name"))).alias("x")).collect()] == ["aws", "", "", "", "ubfa"]
    assert [r.x for r in rows.select(names.is_staffing(names.normalize(F.col("name"))).alias("x")).collect()] == [True, False, False, False, False]
    two = spark.createDataFrame([("one",), ("a b",), ("\U00010400x \U00010401y",)], "n string").select(names.acronym(F.col("n")).alias("x"))
    assert [r.x for r in two.collect()] == ["", "ab", "\U00010400\U00010401"]


def test_names_are_normalised_on_all_cores(spark):
    for name in ("acronyms", "staffing_flags"):
        assert catalog.queries()[name](spark, SF).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_records_do_not_meet_companies_one_by_one(spark):
    firms, given = same_firms(spark, 300)
    held = spark.createDataFrame([(7, "also")], "company_id long, normalized_alias string")
    df = store.new_aliases(given, firms, held)
    found, n = steps(df)
    assert n == 299 and max(out for _, out, _ in found) <= 600
    assert {(r.alias, r.normalized_alias, r.source) for r in df.collect()} == {("Also Inc", "also", "etl:us_petitions")}


def test_pairs_of_companies_and_domains_are_not_hashed(spark):
    firms, given = same_firms(spark, 100)
    df = store.new_domains(given, firms, spark.createDataFrame([(7, "s7.example")], "company_id long, domain string"))
    found, n = steps(df)
    assert n == 9999 and len(set(df.collect())) == 9999
    assert max(out for name, out, _ in found if "Aggregate" in name) <= 100


def test_equal_names_are_scored_once(spark):
    found, n = steps(catalog.queries()["scored_pairs"](spark, SF))
    assert n and max(out for name, out, _ in found if "Join" in name) <= 4 * n  # a name with and without its suffix


def test_pairs_of_similar_names_are_not_shuffled(spark):
    q = spark.range(400).select(F.col("id").alias("query_id"), F.concat(F.lit("orchard lane "), (F.col("id") % 2).cast("string")).alias("name"))
    t = spark.range(1500).select(F.col("id").alias("target_id"), F.lit("orchard lane 1").alias("name"))
    df = resolve.trigram_matches(q, t, floor=0.6, top=None)
    found, n = steps(df)
    assert n == 400 * 1500 and max(sent for _, _, sent in found) <= 10_000
    ranks = df.groupBy("query_id").agg(F.count_distinct("rank").alias("k"), F.max("rank").alias("last"), F.max(F.abs(F.col("rank") - F.col("target_id") - 1)).alias("off")).collect()
    assert len(ranks) == 400 and all((r.k, r.last, r.off) == (1500, 1500, 0) for r in ranks)


def test_lines_are_taken_apart_once(spark):
    line = spark.createDataFrame([("We use Python, C++ and machine learning",)], "line string")
    known = line.select(coverage.known(F.col("line"), ["python", "c++", "machine learning"]).alias("x"))
    assert plan(known).count("regexp_extract_all(") == 1 and sorted(known.first().x) == ["c++", "machine learning", "python"]
    assert plan(line.select(coverage.phrases(coverage.tokens(F.col("line"))).alias("x"))).count("regexp_extract_all(") == 1


def test_texts_are_not_broadcast(spark):
    df = catalog.queries()["keyword_coverage"](spark, SF)
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_pages_are_read_few_at_a_time():
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(["<h1>x</h1>", None] * 500)], ["id", "html"])
    out = list(pages.fields(iter([batch])))
    assert max(b.num_rows for b in out) <= 64 and [i for b in out for i in b.column("id").to_pylist()] == list(range(1000))
    assert out[0].schema.names == ["id", *(f"f_{name}" for name in pages.FIELDS)] and out[0].column("f_title").to_pylist()[:2] == ["x", None]


def test_asked_names_are_normalised_on_all_cores(spark):
    asked = spark.createDataFrame([(1, "Acme Inc", None, None)], "query_id long, name string, country string, domain string").coalesce(1)
    assert resolve._asked(asked).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
