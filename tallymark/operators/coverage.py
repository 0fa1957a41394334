"""Keyword coverage: which terms a posting asks for, and how far a resume covers them.

The lexicon of known skills is a parameter, `skills.TERMS` by default: lower-case terms that fit into a plan as literals. Everything
is built-in expressions over one explode per posting; a posting keeps its `LIMIT` heaviest terms, as the score is defined.

Defined results: a null or empty posting has no terms, score 0 and band weak; a null resume covers nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import skills
from . import fit
from .spread import spread

# fixed values
STOP = (
    "a an the and or but if then than that this these those with without within for from to of in on at by as is are was were be been being have has had do does did will would can could should may might must you your our we us they their it its not no yes about into over under more most "
    "other some such only own same so too very just also across per via using use used work working works role roles team teams company companies year years experience experienced ability able help helps helping including include includes new looking join joining candidate candidates "
    "applicant applicants position positions job jobs opportunity opportunities responsibilities requirements qualifications preferred required plus benefits salary apply who what when where how why all any each both few many much need needs well like day days week weeks month months "
    "time times end ensure ensuring while during between through here there make makes making take takes look looks based upon etc eg ie inc llc ltd corp you.ll we.re"
).split()
NEVER = (
    "small large big high low fast quick slow strong excellent great good best better top solid proven deep broad wide clear simple complex hard easy early late long short full part senior junior lead principal staff mid level entry global local remote hybrid onsite flexible "
    "competitive comprehensive robust scalable reliable efficient effective successful passionate motivated driven curious collaborative dynamic innovative exciting meaningful impactful various several multiple different similar related relevant appropriate significant critical "
    "key core main primary overall general specific detailed thorough careful thoughtful first second third next last previous current recent future past today tomorrow people person team member members colleague colleagues customer customers client clients "
    "user users business businesses organization organizations industry industries market markets world class real true right wrong sure able unable willing ready happy excited plus bonus nice must should would could may might will shall"
).split()
FRAGMENTS = "re ll ve s t d m n st nd rd th don".split()
FRAMES = [
    r"(?i)\b(?:experience|expertise|proficiency|proficient|background|fluency|fluent|familiarity|familiar|skilled|competency|competence)\s+(?:with|in|of|using)\s+([^.;:\n]{2,80})",
    r"(?i)\b(?:knowledge|understanding|command|mastery)\s+of\s+([^.;:\n]{2,80})",
    r"(?i)\b\d+\+?\s*(?:years?|yrs?)\s+(?:of\s+)?(?:experience\s+)?(?:with|in|building|working\s+(?:with|on))?\s*([^.;:\n]{2,80})",
    r"(?i)\b(?:strong|deep|hands-on|working)\s+(?:knowledge|experience|background)\s+(?:with|in|of)\s+([^.;:\n]{2,80})",
    r"(?i)\b(?:ability|able)\s+to\s+([^.;:\n]{2,80})",
]
TOKEN, TAIL, EDGES = r"[a-z][a-z0-9+#./'’-]*[a-z0-9+#]|[a-z]+", r"n?['’](?:s|re|ll|ve|d|t|m)$", r"^[.\-/'’]+|[.\-/'’]+$"
KNOWN, FRAMED, LISTED = 3, 2, 2  # weights of evidence
LIMIT, MOST, SUGGESTED, FEW = 30, 3, 5, 5
STRONG, MODERATE = 70, 45

_NONE = sorted({*STOP, *NEVER, *FRAGMENTS})


def tokens(c: Column) -> Column:
    found = F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))
    bare = F.transform(found, lambda t: F.regexp_replace(F.regexp_replace(t, TAIL, ""), EDGES, ""))
    return F.filter(bare, lambda t: (F.length(t) >= 2) & ~t.isin(FRAGMENTS))


def candidate(word: Column) -> Column:
    """Whether a word can be part of a requirement."""
    return ~word.isin(_NONE)


def _once(c: Column, f) -> Column:
    """f of a column that is worked out once, however often f names it: a lambda's body repeats what it is given."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def phrases(words: Column) -> Column:
    """Candidate words, and pairs of candidates that stand side by side."""
    none = F.array().cast("array<string>")

    def pairs(words: Column) -> Column:
        def at(word: Column, i: Column) -> Column:
            after = F.get(words, i + 1)
            return F.when(candidate(word), F.concat(F.array(word), F.when(candidate(after), F.array(F.concat_ws(" ", word, after))).otherwise(none))).otherwise(none)

        return F.flatten(F.transform(words, at))

    return _once(words, pairs)


CHUNK = r"[a-z0-9]+|[^a-z0-9]"


def known(line: Column, lexicon: list[str]) -> Column:
    """Lexicon terms whose first occurrence in the line stands alone.

    Such a term begins and ends between a word and something else. So the line is cut into words and single other
    characters, and its runs of up to as many of those as the longest term has, from where a term can begin, are looked up
    in the lexicon, one set of literals; only what is found is then searched in the line. The plan does not grow with the lexicon.
    """
    if not lexicon:
        return F.array().cast("array<string>")
    begins = sorted({chunks[0] for t in lexicon if (chunks := re.findall(CHUNK, t))})
    width = max(len(re.findall(CHUNK, t)) for t in lexicon)

    def runs(chunks: Column) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.size(chunks)), lambda i: F.get(chunks, i - 1).isin(begins))
        each = F.transform(at, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(width), F.size(chunks) - i + 1)), lambda n: F.array_join(F.slice(chunks, i, n), "")))
        return F.when(F.size(chunks) > 0, F.flatten(each)).otherwise(F.array().cast("array<string>"))

    def alone(low: Column, term: Column) -> Column:
        at = F.position(term, low)
        before, after = F.when(at > 1, F.substr(low, at - 1, F.lit(1))).otherwise(""), F.substr(low, at + F.length(term), F.lit(1))
        return (at > 0) & ~before.rlike("[a-z0-9]") & ~after.rlike("[a-z0-9]")

    def held(low: Column) -> Column:
        found = F.array_intersect(F.lit(sorted(set(lexicon))), _once(F.regexp_extract_all(low, F.lit(CHUNK), F.lit(0)), runs))
        return F.filter(found, lambda term: alone(low, term))

    return _once(F.lower(line), held)


def requirements(postings: DataFrame, lexicon: list[str] = skills.TERMS) -> DataFrame:
    """(posting_id, term, occurrences, in_requirements, evidence, weight, rank) of the heaviest terms of each posting."""
    lines = fit.sections(spread(postings.select("posting_id", "text"), "posting_id"))
    line, listed = F.col("line"), F.col("line").rlike(fit.BULLET) & F.col("in_requirements")
    framed = F.flatten(F.flatten(F.array(*[F.transform(F.regexp_extract_all(line, F.lit(f), F.lit(1)), lambda x: phrases(tokens(x))) for f in FRAMES])))
    pairs = F.when(listed, F.filter(phrases(tokens(line)), lambda p: p.contains(" "))).otherwise(F.array().cast("array<string>"))
    tag = lambda c, weight, name: F.transform(c, lambda t: F.struct(t.alias("term"), F.lit(weight).alias("base"), F.lit(name).alias("name")))
    found = F.concat(tag(known(line, lexicon), KNOWN, "lexicon"), tag(framed, FRAMED, "frame"), tag(pairs, LISTED, "bullet_phrase"))
    # position keeps the first of equally strong evidence
    rows = lines.select("posting_id", "line_no", "in_requirements", F.posexplode(found).alias("at", "f")).select("posting_id", "line_no", "at", "in_requirements", "f.*")
    rows = rows.where((F.length("term") >= 2) & F.forall(F.split("term", " "), candidate))
    first = F.max_by("name", F.struct("base", -F.col("line_no"), -F.col("at")))
    drafts = rows.groupBy("posting_id", "term").agg(F.count("*").alias("occurrences"), F.bool_or("in_requirements").alias("in_requirements"), first.alias("evidence"), F.max("base").alias("base"))
    weight = F.col("base") * F.least("occurrences", F.lit(MOST)) * F.when(F.col("in_requirements"), 2).otherwise(1)
    order = Window.partitionBy("posting_id").orderBy(F.desc("weight"), F.collate("term", "UNICODE"))
    ranked = drafts.withColumn("weight", weight).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= LIMIT)
    return ranked.select("posting_id", "term", "occurrences", "in_requirements", "evidence", "weight", "rank")


def analyze(pairs: DataFrame, postings: DataFrame, resumes: DataFrame, lexicon: list[str] = skills.TERMS) -> DataFrame:
    """One row per (posting_id, resume_id) of `pairs`: score, band, matched and missing terms, suggestions and summary."""
    entry = F.struct("rank", "term", "occurrences", "in_requirements", "evidence", "weight")
    asked = requirements(postings, lexicon).groupBy("posting_id").agg(F.sort_array(F.collect_list(entry)).alias("terms"))  # LIMIT at most
    words = tokens(F.coalesce("text", F.lit("")))
    side = F.filter(F.transform("words", lambda w, i: F.when(F.get("words", i + 1).isNotNull(), F.concat_ws(" ", w, F.get("words", i + 1)))), lambda p: p.isNotNull())
    have = resumes.select("resume_id", F.lower(F.coalesce("text", F.lit(""))).alias("raw"), words.alias("words")).withColumn("side", side)
    # either side grows with its table, while the plan takes texts made from a narrow file for a few MB: neither is broadcast
    rows = pairs.join(asked.hint("merge"), "posting_id", "left").join(have.hint("merge"), "resume_id", "left")
    covered = lambda e: F.coalesce(F.when(e["term"].contains(" "), F.array_contains("side", e["term"]) | F.contains("raw", e["term"])).otherwise(F.array_contains("words", e["term"])), F.lit(False))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, e: s + e["weight"])
    share = lambda w: F.when(F.col("total_weight") == 0, 0).otherwise(F.floor(w / F.col("total_weight") * 100 + 0.5)).cast("int")
    terms = F.coalesce("terms", F.array().cast(asked.schema["terms"].dataType))
    rows = rows.withColumn("terms", terms).withColumn("hit", F.filter("terms", covered)).withColumn("missing", F.filter("terms", lambda e: ~covered(e)))
    rows = rows.withColumn("total_weight", total(F.col("terms"))).withColumn("matched_weight", total(F.col("hit"))).withColumn("score", share(F.col("matched_weight")))
    advice = lambda e: F.struct(e["term"].alias("term"), share(F.col("matched_weight") + e["weight"]).alias("projected_score"), (share(F.col("matched_weight") + e["weight"]) - F.col("score")).alias("gain"), e["in_requirements"].alias("in_requirements"))
    rows = rows.withColumn("suggestions", F.transform(F.slice("missing", 1, SUGGESTED), advice))
    n, m = F.size("terms"), F.size("hit")
    best = F.get("suggestions", F.lit(0))
    summary = F.when(n < FEW, "This posting does not name enough specific skills to score reliably.").otherwise(
        F.concat_ws(
            " ",
            F.format_string("Your resume covers %d of the %d skills this posting asks for (%d%%).", m, n, F.col("score")),
            F.when(best.isNotNull(), F.format_string("Adding “%s” alone would take it to %d%%.", best["term"], best["projected_score"])),
            F.lit("This models common keyword screening, not any specific employer’s system."),
        )
    )
    return rows.select(
        "posting_id",
        "resume_id",
        "score",
        F.when(F.col("score") >= STRONG, "strong").when(F.col("score") >= MODERATE, "moderate").otherwise("weak").alias("band"),
        F.transform("hit", lambda e: e["term"]).alias("matched"),
        "missing",
        "suggestions",
        n.alias("total_terms"),
        m.alias("matched_terms"),
        "total_weight",
        "matched_weight",
        share(F.col("matched_weight") + total(F.slice("missing", 1, SUGGESTED))).alias("projected_with_all"),
        summary.alias("summary"),
    )
