"""How well one text covers another: term gaps and overlaps, requirement sections, cosine scores and bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: words that are no terms
STOP = (
    "a an the and or but if then than that this these those with without within for from to of in on at by as is are was were be been being have has had do does did will would can could should may might must "
    "you your our we us they their it its not no yes about into over under more most other some such only own same so too very just also across per via using use used work working works role roles team teams "
    "company companies year years experience experienced strong excellent good ability able help helps helping including include includes new great looking join joining candidate candidates applicant applicants "
    "position positions job jobs opportunity opportunities responsibilities requirements qualifications preferred required plus benefits salary apply"
).split()
# fixed values: section headings, short titles and list marks
HEADING = r"(?i)\b(requirements?|qualifications?|what you.{0,3}ll (?:need|bring|do)|who you are|must have|we.{0,3}re looking for|skills?|about you|basic qualifications?|minimum qualifications?|nice to have|preferred)\b"
TITLE = r"^[A-Z][^.!?]{0,60}:?$"
BULLET = r"^\s*(?:[-–—*•‣▪]|\d+[.)])\s+"


TERM, EDGES = r"[a-z][a-z0-9+#.\-/]*[a-z0-9+#]|[a-z]", r"^[.\-/]+|[.\-/]+$"
#: Bytes of asked text up to which its terms are sent to every task that reads the other side.
SENT = 64_000_000


def terms(c: Column) -> Column:
    found = F.transform(F.regexp_extract_all(F.lower(c), F.lit(TERM), F.lit(0)), lambda t: F.regexp_replace(t, EDGES, ""))
    return F.filter(found, lambda t: (F.length(t) >= 2) & ~t.isin(STOP))


def each_term(rows: DataFrame, *keep: str) -> DataFrame:
    """A row for each term of `text`; edges are stripped and stop words dropped after the terms are rows."""
    found = rows.select(*keep, F.explode(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0))).alias("term"))
    return found.withColumn("term", F.regexp_replace("term", EDGES, "")).where((F.length("term") >= 2) & ~F.col("term").isin(STOP))


def _counted(asked: DataFrame, least: int) -> DataFrame:
    return each_term(asked, "id").groupBy("id", "term").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _held(asked: DataFrame, have: DataFrame) -> DataFrame:
    """Distinct terms of `have` that are asked for at all: others are dropped where they are read.

    Terms of a text take no more bytes than the text, so the size of what is asked bounds what is sent to every task.
    """
    wanted = each_term(asked).distinct()
    size = int(str(asked._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return each_term(have).join(F.broadcast(wanted) if size <= SENT else wanted, "term", "left_semi").distinct()


def term_gaps(asked: DataFrame, have: DataFrame, *, least: int = 2, limit: int = 6) -> DataFrame:
    """Terms that an asked text (id, text) stresses and no text of `have` holds: (id, term, n, rank)."""
    return _top(_counted(asked, least).join(_held(asked, have), "term", "left_anti"), limit)


def term_overlaps(asked: DataFrame, have: DataFrame, *, limit: int = 5) -> DataFrame:
    return _top(_counted(asked, 1).join(_held(asked, have), "term", "left_semi"), limit)


def _top(rows: DataFrame, limit: int) -> DataFrame:
    order = Window.partitionBy("id").orderBy(F.desc("n"), "term")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("id", "term", "n", "rank")


def sections(postings: DataFrame) -> DataFrame:
    """(posting_id, line_no, line, in_requirements): a heading opens the section, a short title-case line closes it."""
    lines = postings.select("posting_id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw")).withColumn("line", F.regexp_replace("raw", r"^[\s\u00a0\ufeff]+|[\s\u00a0\ufeff]+$", "")).where("line <> ''")
    title = F.col("line").rlike(TITLE) & ~F.col("line").rlike(BULLET)
    event = F.when(F.col("line").rlike(HEADING), F.lit(True)).when(title, F.lit(False))
    upto = Window.partitionBy("posting_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    state = F.coalesce(F.last(event, ignorenulls=True).over(upto), F.lit(False))
    return lines.select("posting_id", "line_no", "line", state.alias("in_requirements"))


def cosine(a: Column, b: Column) -> Column:
    """0 for empty, unlike long or zero vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == 0) | (F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)


def fit_score(similarity: Column) -> Column:
    return F.floor((F.least(F.lit(0.75), F.greatest(F.lit(0.25), similarity)) - 0.25) / 0.5 * 100 + 0.5).cast("int")


def fit_band(score: Column) -> Column:
    return F.when(score >= 70, "strong").when(score >= 40, "moderate").otherwise("weak")


# fixed values: what a band says, and the sentences around the terms
OPENINGS = {
    "strong": "Your resume reads as closely related to this posting.",
    "moderate": "Your resume overlaps with this posting in places.",
    "weak": "Your resume and this posting have little language in common.",
}
SHARED, STRESSED, CAVEAT = ("Shared emphasis: ", "."), ("The posting stresses ", ", which your resume does not mention."), "This compares wording, not qualifications."


def rationale(band: Column, overlaps: Column, gaps: Column, most: int = 4) -> Column:
    """The score in words: an opening, up to `most` shared and missing terms, and a caveat."""
    opening = F.coalesce(*[F.when(band == b, t) for b, t in OPENINGS.items()])
    some = lambda c, around: F.when(F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0, F.concat(F.lit(around[0]), F.array_join(F.slice(c, 1, most), ", "), F.lit(around[1])))
    return F.concat_ws(" ", opening, some(overlaps, SHARED), some(gaps, STRESSED), F.lit(CAVEAT))


def matches(pairs: DataFrame) -> DataFrame:
    """(id, score, band, rationale, gaps) of pairs (id, resume, posting, resume_vector, posting_vector)."""
    rows = pairs.select("id", terms(F.col("resume")).alias("have"), terms(F.col("posting")).alias("asked"), fit_score(cosine(F.col("resume_vector"), F.col("posting_vector"))).alias("score"))
    each = rows.select("id", "have", F.explode("asked").alias("term")).groupBy("id", "term").agg(F.count("*").alias("n"), F.coalesce(F.any_value(F.array_contains("have", F.col("term"))), F.lit(False)).alias("held"))
    ranked = lambda some, least, limit, name: (
        _top(each.where(some & (F.col("n") >= least)).select("id", "term", "n"), limit)
        .groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias(name))
    )
    rows = rows.select("id", "score", fit_band(F.col("score")).alias("band")).join(ranked(~F.col("held"), 2, 6, "gaps"), "id", "left").join(ranked(F.col("held"), 1, 5, "overlaps"), "id", "left")
    none = F.array().cast("array<string>")
    return rows.select("id", "score", "band", rationale(F.col("band"), F.col("overlaps"), F.col("gaps")).alias("rationale"), F.coalesce("gaps", none).alias("gaps"))
