from urllib.parse import parse_qs, urlsplit

from pyspark.sql import functions as F

from tallymark.functions import links
from tallymark.operators import coverage

POSTING = "Engineer\nRequirements\n- 5+ years of experience with Kafka streams and Python\n- Don't forget javascript; knowledge of node.js\nAbout us\nWe use python and C++."
LEXICON = ["python", "java", "c++", "node.js", "r"]


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "x string").select(f(F.col("x")).alias("y")).first().y


def test_tokens_and_phrases(spark):
    assert one(spark, "Node.js, C++ and CI/CD — we'll don't H-1B x", coverage.tokens) == ["node.js", "c++", "and", "ci/cd", "we", "do", "h-1b"]
    assert one(spark, "kafka streams and python", lambda c: coverage.phrases(coverage.tokens(c))) == ["kafka", "kafka streams", "streams", "python"]


def test_known_stands_alone(spark):
    # only the first occurrence is looked at
    assert one(spark, "javascript, java and r", lambda c: coverage.known(c, ["java", "r", "javascript"])) == ["javascript"]
    assert one(spark, "C++", lambda c: coverage.known(c, ["c++"])) == ["c++"]


def test_requirements(spark):
    rows = coverage.requirements(spark.createDataFrame([(1, POSTING), (2, ""), (3, None)], "posting_id long, text string"), LEXICON).collect()
    got = {r.term: (r.occurrences, r.in_requirements, r.evidence, r.weight) for r in rows}
    assert {r.posting_id for r in rows} == {1}
    # one frame (experience with) and one more (5+ years of experience with) read the same words; then the lexicon, twice
    assert got["python"] == (4, True, "lexicon", 18)
    assert got["kafka streams"] == (3, True, "frame", 12)
    assert got["kafka"] == (2, True, "frame", 8)
    # a frame's text ends at a full stop, so the frame of this line holds "node" alone
    assert got["node.js"] == (1, True, "lexicon", 6) and got["node"] == (1, True, "frame", 4)
    assert got["c++"] == (1, False, "lexicon", 3)
    assert "java" not in got and "r" not in got
    assert [r.rank for r in sorted(rows, key=lambda r: (-r.weight, r.term))] == list(range(1, len(rows) + 1))


def test_analyze(spark):
    postings = spark.createDataFrame([(1, POSTING), (2, "")], "posting_id long, text string")
    resumes = spark.createDataFrame([(1, "Python; kafka streams"), (2, None)], "resume_id long, text string")
    pairs = spark.createDataFrame([(p, r) for p in (1, 2) for r in (1, 2)], "posting_id long, resume_id long")
    got = {(r.posting_id, r.resume_id): r for r in coverage.analyze(pairs, postings, resumes, LEXICON).collect()}
    a = got[1, 1]
    assert set(a.matched) == {"python", "kafka streams", "kafka", "streams"}
    assert a.score == int(a.matched_weight / a.total_weight * 100 + 0.5)
    assert a.matched_terms + len(a.missing) == a.total_terms
    best = a.suggestions[0]
    assert best.term == "node.js" and best.projected_score == int((a.matched_weight + 6) / a.total_weight * 100 + 0.5) and best.gain == best.projected_score - a.score
    assert a.projected_with_all == int((a.matched_weight + sum(m.weight for m in a.missing[:5])) / a.total_weight * 100 + 0.5)
    assert f"Adding “node.js” alone would take it to {best.projected_score}%." in a.summary
    assert (got[1, 2].score, got[1, 2].band) == (0, "weak")
    assert (got[2, 1].score, got[2, 1].total_terms, got[2, 1].projected_with_all) == (0, 0, 0)
    assert got[2, 1].summary.startswith("This posting does not name")


def test_links(spark):
    assert one(spark, "A (b) & c!", links.component) == "A%20(b)%20%26%20c!"
    url = one(spark, "Acme & Co", lambda c: links.mismatch_report("o/r", c, F.upper(c), F.lit("https://x/company/acme"), "end"))
    found = parse_qs(urlsplit(url).query)
    assert found["title"] == ['Wrong match: "Acme & Co" → "ACME & CO"'] and "company page" in found["body"][0] and found["body"][0].endswith("\nend")
