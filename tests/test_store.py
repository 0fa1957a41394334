import pytest

from tallymark.operators import fit, gates, store
from tallymark.sources import registers


def test_unknown_source_fails_the_query(spark):
    sources = spark.createDataFrame([("a", "A register", "US")], "id string, label string, country string")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "source_id string, v int")
    assert store.known_sources(rows.where("v = 1"), sources).collect()[0].label == "A register"
    with pytest.raises(Exception, match="unknown source: b"):
        store.known_sources(rows, sources).collect()


def test_files_may_lack_optional_columns(spark, tmp_path):
    path = tmp_path / "lmia-2024-06-30.csv"
    path.write_text("Report\n\nEmployer,Approved Positions\nAcme,3\nAcme,4\nNone,0\n")
    rows = registers.read_assessments(spark, str(path), "2024-06-30").collect()
    assert [(r.company_name, r.metric, float(r.value), r.extra) for r in rows] == [("Acme", "positions", 7.0, {})]
    gb = spark.createDataFrame([("Acme", "Leeds"), ("Acme", "York"), (" ", "x")], ["Organisation Name", "Town/City"])
    rows = registers.register(gb.coalesce(1), "2024-06-30").collect()
    assert [(r.company_name, r.extra) for r in rows] == [("Acme", {"city": "Leeds"})]
    found = registers.discover(spark, str(tmp_path / "*.csv")).collect()
    assert [str(r.published) for r in found] == ["2024-06-30"]


def test_bands_and_rationale(spark):
    rows = spark.range(0, 101, 1).select(fit.fit_band(fit.F.col("id")).alias("b")).collect()
    assert [rows[i].b for i in (0, 39, 40, 69, 70, 100)] == ["weak", "weak", "moderate", "moderate", "strong", "strong"]
    pairs = spark.createDataFrame([(1, "", "", None, None), (2, None, "alpha alpha", [1.0], [1.0])], "id int, resume string, posting string, resume_vector array<double>, posting_vector array<double>")
    got = {r.id: r for r in fit.matches(pairs).collect()}
    assert got[1].gaps == [] and got[1].rationale.endswith("This compares wording, not qualifications.")
    assert got[2].gaps == ["alpha"]


def test_response_without_a_source(spark):
    f = gates.F
    one = spark.range(1)
    fault = lambda kind, records: one.select(gates.verdict_fault(f.lit(kind), f.lit("m"), records, f.lit("q"), f.lit(None)).alias("x")).collect()[0].x
    none = f.array().cast("array<array<string>>")
    assert fault("verified", none) is None and fault("error", none) is None
    assert fault("verified", f.array(f.array().cast("array<string>"))) == "data without a source"
    assert fault("other", none) == "unexpected response"
