"""Names to verdicts: blocks within countries, scores against plain definitions, records with their sources."""

import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallymark.functions import similarity
from tallymark.operators import facts, history, resolve
from tallymark.sources import registry

COMPANY = "company_id long, canonical_name string, normalized_name string, country string"
QUERY = "query_id long, name string, country string, domain string"
NO_ALIAS, NO_DOMAIN = "company_id long, alias string, normalized_alias string", "company_id long, domain string"


def found(spark, asked, companies, aliases=(), domains=(), what=resolve.candidates):
    tables = (spark.createDataFrame(asked, QUERY), spark.createDataFrame(companies, COMPANY), spark.createDataFrame(list(aliases), NO_ALIAS), spark.createDataFrame(list(domains), NO_DOMAIN))
    return what(*tables).collect()


FIRMS = [(i, f"Orchard Lane {i} LLC", f"orchard lane {i}", "US") for i in range(1, 41)] + [(99, "Orchard Lane Foods Ltd", "orchard lane foods", "GB")]


def test_a_country_is_asked_before_the_block_is_cut(spark):
    rows = found(spark, [(1, "Orchard Lane", "GB", None), (2, "orchard lane", "gb", None), (3, "Orchard Lane", "US", None), (4, "Orchard Lane", None, None), (5, "Orchard Lane", "DE", None)], FIRMS)
    of = {q: sorted(r.company_id for r in rows if r.query_id == q) for q in range(1, 6)}
    assert of[1] == of[2] == [99]
    assert len(of[3]) == 25 and 99 not in of[3]
    assert of[4] == of[5] and len(of[4]) == 25  # an unsupported country asks all


def test_blocks_by_alias_and_domain_keep_to_the_country(spark):
    aliases = [(i, f"Zebra {i}", f"zebra {i}") for i in range(1, 41)] + [(99, "Zebra GB", "zebra gb")]
    domains = [(3, "zebra.example"), (99, "zebra.example")]
    rows = found(spark, [(1, "Zebra", "GB", "https://www.zebra.example/x"), (2, "Quite Other", "GB", "zebra.example"), (3, "...", "GB", "zebra.example"), (4, "Quite Other", None, "zebra.example")], FIRMS, aliases, domains)
    of = {q: sorted(r.company_id for r in rows if r.query_id == q) for q in range(1, 5)}
    assert of == {1: [99], 2: [99], 3: [], 4: [3, 99]}
    best = {r.query_id: r for r in found(spark, [(2, "Quite Other", None, "zebra.example"), (7, "zebra gb", None, None)], FIRMS, aliases, domains, resolve.resolve)}
    assert (best[2].company_id, best[2].method, best[2].score, best[2].confidence) == (3, "domain", 1.0, "high")
    assert (best[7].company_id, best[7].matched_name, best[7].warnings) == (99, "Zebra GB", ["matched_via_alias"])


def test_equal_names_are_joined_once(spark):
    firms = [(i, "Same Name Inc", "same name", ("US", "GB", "CA")[i % 3]) for i in range(3000)]
    asked = [(i, "Same Name", (None, "US", "gb")[i % 3], None) for i in range(600)]
    rows = found(spark, asked, firms)
    assert len(rows) == 600 * 25
    assert {r.company_id for r in rows if r.query_id % 3 == 1} == set(range(0, 75, 3)) and {r.company_id for r in rows if r.query_id % 3 == 0} == set(range(25))
    near = resolve.similar_names(spark.createDataFrame([(n,) for _, n, _, _ in asked], "name string"), spark.createDataFrame([(f[2],) for f in firms], "name string"))
    assert near.count() == 1


def test_similar_names_equal_all_pairs(spark):
    rng = random.Random(4)
    some = sorted({" ".join(rng.choice(["alpha", "alpine", "beta", "betamax", "gamma ray", "ünï", "ab", "a", "zz top"]) for _ in range(rng.randint(1, 4))) for _ in range(120)})
    grams = lambda s: {("  " + w + " ")[i : i + 3] for w in s.split() for i in range(len(w) + 1)}
    for floor in (0.3, 0.55, 0.8):
        want = {(a, b) for a in some for b in some if len(grams(a) & grams(b)) / len(grams(a) | grams(b)) >= floor - 1e-12}
        rows = spark.createDataFrame([(n,) for n in some], "name string")
        assert {(r.probe, r.name) for r in resolve.similar_names(rows, rows, floor).collect()} == want


def plain_lcs(a, b):
    row = [0] * (len(a) + 1)
    for c in b:
        last = row
        row = [0]
        for i, d in enumerate(a):
            row.append(last[i] + 1 if c == d else max(last[i + 1], row[i]))
    return row[-1]


def test_pair_scores_equal_the_plain_ones():
    rng = random.Random(3)
    some = "acme global data systems of the international business machines ibm apple bank for savings stripe payments é ünï corp works staffing zq12".split()

    def name():
        text = list(" ".join(rng.choice(some) for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4, 5, 9, 14]))))
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            if text:
                text[rng.randrange(len(text))] = rng.choice("abcxyz")
        return " ".join("".join(text).split())

    pairs = [(name(), name()) for _ in range(10_000)] + [("ibm", "international business machines"), ("a" * 70, "a" * 64 + "b"), ("a" * 64, "a" * 64 + "c")]
    for a, b in pairs[:1500]:
        assert similarity._lcs(a, b) == plain_lcs(a, b)
    score, method = similarity.pair_scores([a for a, _ in pairs], [b for _, b in pairs])
    floored, _ = similarity.pair_scores([a for a, _ in pairs], [b for _, b in pairs], 0.7)
    for (a, b), s, m, f in zip(pairs, score, method, floored, strict=True):
        want = similarity.pair_score(a, b)
        assert (pytest.approx(want[0]), want[1]) == (s, m), (a, b)
        assert (s < 0.7 and f <= s) or f == s


def test_known_names():
    score = similarity.pair_score
    assert score("google", "google") == (1.0, "exact_normalized") and score("", "google") == (0.0, "empty")
    assert score("ibm", "international business machines") == (0.86, "acronym")
    assert score("stripe", "lockheed martin")[0] < 0.7 <= score("micorsoft", "microsoft")[0]
    assert score("microsft", "microsoft")[0] <= 0.94
    assert score("apple", "apple bank for savings")[0] < 0.95 and score("stripe", "stripe payments")[1] == "token_prefix"


STATS = "company_id long, country string, year int, metric string, value decimal(14,2), source_id string, published_date date"


def day(y, m=1, d=1):
    return datetime.date(y, m, d)


def test_verdicts_from_names(spark):
    companies = [(1, "Acme Works Inc", "acme works", "US"), (2, "Acme Works Ltd", "acme works", "GB"), (3, "Silent Firm", "silent firm", "CA")]
    stats = [(1, "US", 2023, "initial_approvals", 10, "us_petitions", day(2024)), (1, "US", 2024, "initial_approvals", 15, "us_petitions", day(2025, 1, 15)), (1, "US", 2024, "perm_certified", 3, "us_certifications", day(2025)), (2, "GB", None, "licensed_sponsor", 1, "uk_register", day(2025))]
    asked = spark.createDataFrame([(1, "Acme Works", "us", None), (2, "Acme Works", "GB", None), (3, "Acme Works", "DE", None), (4, "Silent Firm", None, None), (5, "Nobody At All", "CA", None), (6, "", None, None)], QUERY)
    table = spark.createDataFrame(companies, COMPANY)
    matches = resolve.resolve(asked, table, spark.createDataFrame([], NO_ALIAS), spark.createDataFrame([], NO_DOMAIN)).join(table.select("company_id", "canonical_name"), "company_id")
    facts_held = spark.createDataFrame([(*s[:4], Decimal(s[4]), *s[5:]) for s in stats], STATS)
    told = facts.verdicts(asked, matches, facts_held, registry.sources(spark)).withColumn("history", history.describe(F.col("records")))
    got = {r.query_id: r for r in told.collect()}
    assert {q: r.kind for q, r in got.items()} == {1: "verified", 2: "verified", 3: "verified", 4: "no_record", 5: "no_record", 6: "no_record"}
    assert got[1].countries_checked == ["US"] and got[3].countries_checked == ["US", "GB", "CA"] == got[4].countries_checked
    us = got[1].records[0]
    assert us.country == "US" and us.metrics == {"initial_approvals": 25, "perm_certified": 3} and us.years == [2023, 2024]
    assert [(s.id, s.published_date) for s in us.sources] == [("us_certifications", day(2025)), ("us_petitions", day(2025, 1, 15))]
    assert all(s.label and s.publisher and s.url.startswith("https://") for s in us.sources)
    assert got[1].history == "about 28 approvals, most recently in 2024"
    assert got[2].history == "they hold a current sponsor licence" and got[2].records[0].years == []
    assert got[3].match.company_id == 1 and [r.country for r in got[3].records] == ["US"]
    assert got[4].match is None and got[4].records is None and got[4].history is None
    odd = facts_held.withColumn("source_id", F.lit("nowhere"))
    with pytest.raises(Exception, match="unknown source: nowhere"):
        facts.verdicts(asked, matches, odd, registry.sources(spark)).collect()


def test_wording(spark):
    one = spark.range(1)
    tell = lambda c: one.select(c.alias("x")).first().x
    years = lambda *y: F.array(*map(F.lit, y)).cast("array<int>")
    assert [tell(history.span(years(*y))) for y in ((), (2020,), (2020, 2021, 2022), (2019, 2021))] == ["", "2020", "2020–2022", "2019, 2021"]
    assert tell(history.number(F.lit(1234567.5))) == "1,234,568" and tell(history.day(F.lit(day(2024, 3, 9)))) == "Mar 9, 2024"
    assert tell(history.no_match_copy(F.lit("disabled"))) == "Resume matching is turned off in settings."
    assert tell(history.no_match_copy(F.lit(None).cast("string"))) == "Resume matching is unavailable for this posting."
    none = F.array(F.struct(F.lit("US").alias("country"), F.create_map(F.lit("initial_denials"), F.lit(4)).alias("metrics"), years(2022).alias("years")))
    assert tell(history.describe(none)) == "they last appear in the data for 2022"


def test_sources_are_described_and_unknown_ones_fail():
    assert len(registry.SOURCES) == 5 and all(all(row) for row in registry.SOURCES)
    with pytest.raises(KeyError, match="unknown source id 'other'"):
        registry.source("other")
