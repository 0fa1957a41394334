import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallymark.functions import names, similarity
from tallymark.operators import phrases
from tallymark.sources import registers

NORMAL = {
    "Acme, Inc.": "acme", "A.C.M.E. LLC": "acme", "Nestlé S.A.": "nestle", "H & M": "h and m", "Ernst & Young U.S. LLP": "ernst and young us", "JPMORGAN CHASE & CO": "jpmorgan chase and",
    "Limited Brands": "limited brands", "Group": "group", "Acme | Careers": "acme", "": "", "AT&T": "at and t", "Private Limited": "private",
}


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("name", NORMAL)
def test_normalize(spark, name):
    assert one(spark, name, names.normalize) == NORMAL[name]


@pytest.mark.parametrize("cell, value", [("1,234", 1234), (None, 0), ("-", 0), ("N/A", 0), ("3.9", 3), ("-2.5", -2), ("inf", 0), ("nan", 0), (" 7 ", 7)])
def test_to_int(spark, cell, value):
    assert one(spark, cell, names.to_int) == value


def test_find_column():
    assert registers.find_column(["Fiscal Year", "Employer (Petitioner) Name"], "employer") == "Employer (Petitioner) Name"
    with pytest.raises(KeyError):
        registers.find_column(["a"], "employer")


NAME_PAIRS = {
    ("Apple", "Apple Bank for Savings"): (0.7537, "token_prefix"), ("Stripe", "Stripe Payments Company"): (0.8643, "token_prefix"),
    ("IBM", "International Business Machines"): (0.86, "acronym"), ("X", "x"): (1.0, "exact_normalized"), ("", "x"): (0.0, "empty"),
}


@pytest.mark.parametrize("pair", NAME_PAIRS)
def test_pair_scores(spark, pair):
    """Scores are defined on normalised names, so the names go through normalize first."""
    rows = spark.createDataFrame([pair], "q string, c string").select(names.normalize(F.col("q")).alias("q"), names.normalize(F.col("c")).alias("c"))
    got = rows.select(similarity.score_pairs(F.col("q"), F.col("c")).alias("s")).first().s
    assert (got.score, got.method) == (pytest.approx(NAME_PAIRS[pair][0], abs=1e-4), NAME_PAIRS[pair][1])


@given(st.text("ab ", max_size=12), st.text("ab ", max_size=12))
def test_scores_are_bounded(a, b):
    a, b = " ".join(a.split()), " ".join(b.split())
    score, method = similarity.pair_score(a, b)
    assert 0 <= score <= (1.0 if method == "exact_normalized" else 0.94)
    n = len(a)
    lcs = [[0] * (len(b) + 1) for _ in range(n + 1)]
    for i in range(n):
        for j in range(len(b)):
            lcs[i + 1][j + 1] = lcs[i][j] + 1 if a[i] == b[j] else max(lcs[i][j + 1], lcs[i + 1][j])
    assert similarity._lcs(a, b) == lcs[n][len(b)]


SIGNALS = {
    "We are happy to sponsor visas.": "positive", "We do not offer visa sponsorship.": "negative", "Do you need sponsorship?": "none", "Must be a US citizen.": "negative", "Relocation assistance provided.": "positive",
    "Unfortunately sponsorship is not available, but relocation is offered.": "negative", "": "none", "We sponsor events.": "positive", "Right to work is not required.": "positive",
}


def test_signals(spark):
    rows = spark.createDataFrame(list(enumerate(SIGNALS)), "posting_id long, text string")
    got = {r.posting_id: r.polarity for r in phrases.signals(rows).collect()}
    assert [got[i] for i in range(len(SIGNALS))] == list(SIGNALS.values())


def test_canada_header(spark, tmp_path):
    path = tmp_path / "ca.csv"
    path.write_text("Title\n2024\n\nEmployer,Approved Positions,Approved LMIAs\nMaple,2,1\nMaple,3,0\nTotal,9,9\nZero,0,0\n")
    got = registers.read_assessments(spark, str(path), "2024-01-01").collect()
    assert {(r.company_name, r.metric, float(r.value), r.year) for r in got} == {("Maple", "positions", 5.0, 2024), ("Maple", "assessments", 1.0, 2024)}
