"""Negation-aware classification of posting text: clauses, hard patterns, anchors in windows, one signal per posting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: anchors as (words, weight); offers read positive on their own, requirements negative
OFFERS = [("sponsorship", 3), ("sponsor", 3), ("sponsors", 3), ("sponsoring", 3), ("sponsored", 3), ("visa support", 3), ("visa assistance", 3), ("relocation package", 1), ("relocation assistance", 1), ("relocation support", 1), ("relocation", 1)]
REQUIREMENTS = [
    ("right to work", 2), ("authorized to work", 2), ("authorised to work", 2), ("work authorization", 2), ("work authorisation", 2), ("eligible to work", 2), ("entitled to work", 2), ("work permit", 2), ("existing visa", 2), ("valid visa", 2),
    ("us citizen", 3), ("us citizens", 3), ("citizenship", 3), ("green card", 3), ("permanent resident", 3), ("security clearance", 3), ("itar", 3),
]
# fixed values: words that negate, and the marks that end a window
NEGATIONS = set("not don't doesn't won't can't cannot isn't aren't wasn't weren't couldn't no never without unable ineligible unfortunately excluded denied lacking preclude precludes".split())
BARRIERS = set(",;:—–()")
WINDOW = 5
# fixed values: whole constructions, weight 4
NEGATIVE = {
    "sponsorship-not-available": r"\bsponsorship\b[^.!?\n]{0,40}?\b(?:is|are|will\s+be|can\s+be)?\s*not\s+(?:be\s+)?(?:available|offered|provided|possible|considered|supported)\b",
    "without-sponsorship": r"\bwithout\s+(?:the\s+)?(?:need|requirement)?\s*(?:for|of)?\s*(?:visa\s+|employer\s+|company\s+)?sponsorship\b",
    "unable-to-sponsor": r"\b(?:unable|not\s+able|not\s+in\s+a\s+position|do\s+not\s+intend)\s+to\s+(?:offer|provide|support|sponsor)\b",
    "do-not-sponsor": r"\b(?:do|does|will|can)\s+not\b[^.!?\n]{0,30}?\bsponsor(?:ship)?\b",
    "no-sponsorship": r"\bno\s+(?:visa\s+|employment\s+|employer\s+)?sponsorship\b",
    "must-already-hold": r"\bmust\s+(?:already\s+)?(?:have|possess|hold|be)\b[^.!?\n]{0,50}?\b(?:right\s+to\s+work|work\s+authorization|work\s+authorisation|work\s+permit|valid\s+visa|existing\s+visa)\b",
    "requiring-sponsorship-not-considered": r"\b(?:requiring|require|requires|needing)\s+(?:visa\s+)?sponsorship\b[^.!?\n]{0,40}?\b(?:not|cannot|won't|will\s+not|unable)\b",
    "citizenship-required": r"\b(?:must\s+be|require[sd]?|only|restricted\s+to)\b[^.!?\n]{0,30}?\b(?:u\.?s\.?|united\s+states|american)\s+citizens?(?:hip)?\b|\b(?:u\.?s\.?|united\s+states)\s+citizens?\s+only\b",
    "citizen-or-green-card-only": r"\bcitizens?\b[^.!?\n]{0,30}?\b(?:green\s+card|permanent\s+residents?|lawful\s+permanent)\b",
    "clearance-required": r"\b(?:active\s+)?(?:security\s+clearance|ts\/sci|top\s+secret|itar|export\s+control)\b[^.!?\n]{0,30}?\b(?:required|require[sd]|must|eligible)\b|\bmust\s+(?:be\s+able\s+to\s+)?(?:obtain|hold)\s+(?:a\s+)?(?:security\s+)?clearance\b",
    "named-visa-refused": r"\b(?:no|not|cannot|can't|unable\s+to\s+sponsor|won't\s+sponsor)\b[^.!?\n]{0,30}?\b(?:h-?1-?b|h1|opt|cpt|ead|tn\s+visa|e-?3|o-?1|stem\s+opt)\b",
}
POSITIVE = {
    "named-visa-welcomed": r"\b(?:h-?1-?b|opt|cpt|stem\s+opt|e-?3|tn|o-?1)\b[^.!?\n]{0,30}?\b(?:welcome|welcomed|accept(?:ed)?|eligible|encouraged|considered|transfers?)\b|\b(?:welcome|accept|consider|encourage)[a-z]*\b[^.!?\n]{0,30}?\b(?:h-?1-?b|opt|cpt|e-?3|tn|o-?1)\b",
    "sponsorship-available": r"\b(?:visa\s+|employment\s+|employer\s+)?sponsorship\b[^.!?\n]{0,30}?\b(?:is|are|will\s+be)?\s*(?:available|offered|provided|possible|supported)\b",
    "willing-to-sponsor": r"\b(?:open|happy|willing|able|prepared|glad)\s+to\s+sponsor(?:ing)?\b",
    "we-sponsor": r"\b(?:we|our\s+(?:company|team)|the\s+company|employer)\s+(?:do\s+|does\s+|can\s+|will\s+|regularly\s+)?sponsors?\b(?!\s+(?:events|conferences|meetups))",
    "rtw-not-required": r"\b(?:right\s+to\s+work|work\s+authorization|work\s+authorisation|work\s+permit)\b[^.!?\n]{0,25}?\bnot\s+(?:be\s+)?(?:required|necessary|needed)\b",
    "will-assist-permit": r"\b(?:obtain|provide|arrange|assist\s+with|help\s+with|support\s+with)\s+(?:a\s+|the\s+|your\s+)?(?:work\s+permit|work\s+visa|visa)\b",
}
TOKEN = r"[a-z0-9][a-z0-9'’\-]*|[,;:—–()]"
_ORDERED = sorted([(a.split(), w, 1) for a, w in OFFERS] + [(a.split(), w, -1) for a, w in REQUIREMENTS], key=lambda x: -len(x[0]))
#: A clause without any of these holds no construction.
GATE = r"(?i)sponsor|right|authori|permit|citizen|clearance|secret|itar|export|ts/sci|visa|h-?1|opt|cpt|ead|tn|e-?3|o-?1|offer|provide|support"


def ascii_edges(pattern: str) -> str:
    """Word borders of ASCII words, whatever letters stand around."""
    return r"(?i)" + pattern.replace(r"\b", r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))")


def clauses(postings: DataFrame) -> DataFrame:
    """(posting_id, sentence_no, clause_no, clause, interrogative)."""
    sentences = postings.select("posting_id", F.posexplode(F.split("text", r"(?<=[.!?])(?U:\s)+|\n+")).alias("sentence_no", "s"))
    sentences = sentences.withColumn("s", F.regexp_replace("s", r"^(?U:\s)+|(?U:\s)+$", "")).where("s <> ''").withColumn("interrogative", F.endswith("s", F.lit("?")))
    cut = r"(?i);|,\s+(?:but|however|although|though|whereas|while)\b"
    parts = sentences.select("posting_id", "sentence_no", "interrogative", F.posexplode(F.split("s", cut)).alias("clause_no", "c"))
    return parts.withColumn("clause", F.regexp_replace("c", r"^(?U:\s)+|(?U:\s)+$", "")).where(F.length("clause") >= 3).select("posting_id", "sentence_no", "clause_no", "clause", "interrogative")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def constructions(clause: Column) -> Column:
    """The constructions in a clause: array of (k, cue, polarity, weight), k their order in the tables."""
    tables = [(sign, k, p) for sign, table in ((-1, NEGATIVE), (1, POSITIVE)) for k, p in table.items()]
    entry = lambda i, sign, k: F.struct(F.lit(i).alias("k"), F.lit(f"hard:{k}").alias("cue"), F.lit(sign).alias("polarity"), F.lit(4).alias("weight"))
    found = [F.when(clause.rlike(ascii_edges(p)), entry(i, sign, k)) for i, (sign, k, p) in enumerate(tables, 1)]
    hits = F.filter(F.array(*found), lambda x: x.isNotNull())
    return F.when(clause.rlike(GATE), hits).otherwise(F.array().cast("array<struct<k:int,cue:string,polarity:int,weight:int>>"))


def hard_hits(rows: DataFrame) -> DataFrame:
    """The constructions in each clause that is no question: adds `cue` and `polarity`."""
    return rows.where(~F.col("interrogative")).withColumn("h", F.explode(constructions(F.col("clause")))).select(*rows.columns, "h.cue", "h.polarity")


def anchor_hits(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray]:
    """Anchors in many lists of words: list, place in it, order of the anchor, cue, polarity, weight of each hit.

    Words are compared as codes over the flat array of all lists, longest anchors first, each word used once. A negation
    turns the polarity if it is within `WINDOW` words on either side and no barrier stands between: the last (next)
    negation and barrier of every place are running maxima (minima).
    """
    coded = words.flatten().dictionary_encode()
    known = {w: i for i, w in enumerate(coded.dictionary.to_pylist())}
    code = coded.indices.to_numpy().astype(np.int64)
    n, sizes = len(code), pc.list_value_length(words).fill_null(0).to_numpy().astype(np.int64)
    of = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(n)
    kind = np.zeros(len(known) + 1, np.int8)
    kind[[i for w, i in known.items() if w.replace("’", "'") in NEGATIONS]] = 1
    kind[[i for w, i in known.items() if w in BARRIERS]] = 2
    kind = kind[code]
    last = lambda k: np.maximum.accumulate(np.where(kind == k, place, -1))
    next_ = lambda k: np.minimum.accumulate(np.where(kind == k, place, n)[::-1])[::-1]
    last_no, last_bar, next_no, next_bar = (f(k) if n else place for f in (last, next_) for k in (1, 2))
    used, found = np.zeros(n, bool), []
    for order, (anchor, weight, sign) in enumerate(_ORDERED):
        codes = [known.get(w, -1) for w in anchor]
        m = len(anchor)
        if n < m or -1 in codes:
            continue
        at = np.flatnonzero(np.logical_and.reduce([(code[k : n - m + 1 + k] == c) & ~used[k : n - m + 1 + k] for k, c in enumerate(codes)]))
        at = at[of[at] == of[at + m - 1]]
        used[(at[:, None] + np.arange(m)).ravel()] = True
        before, after = at - 1, at + m
        left = np.where(before >= starts[of[at]], before, 0)
        left = (before >= starts[of[at]]) & (last_no[left] > last_bar[left]) & (last_no[left] > before - WINDOW) & (last_no[left] >= starts[of[at]])
        ends = (starts + sizes)[of[at]]
        right = np.where(after < ends, after, n - 1)
        right = (after < ends) & (next_no[right] < next_bar[right]) & (next_no[right] < after + WINDOW) & (next_no[right] < ends)
        flip = left | right
        found.append((of[at], at - starts[of[at]], np.full(len(at), order), np.where(flip, "-".join(anchor) + ":negated", "-".join(anchor)), np.where(flip, -sign, sign), np.full(len(at), weight)))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, [], none, none
    lists, places, orders, cues, signs, weights = (np.concatenate(x) for x in zip(*found, strict=True))
    by = np.lexsort((places, orders, lists))
    return lists[by], places[by], orders[by], cues[by].tolist(), signs[by], weights[by]


_SOFT = pa.list_(pa.struct([("k", pa.int32()), ("cue", pa.string()), ("polarity", pa.int32()), ("weight", pa.int32())]))


def _with_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each row's `hits` those of the anchors in `words`; k goes on behind the constructions."""
    first = len(NEGATIVE) + len(POSITIVE) + 1
    for batch in batches:
        lists, _, _, cues, signs, weights = anchor_hits(batch.column(batch.schema.get_field_index("words")))
        counts = np.bincount(lists, minlength=batch.num_rows)
        offsets = np.r_[0, np.cumsum(counts)]
        k = first + np.arange(len(lists)) - offsets[lists]
        entries = pa.StructArray.from_arrays([pa.array(k, pa.int32()), pa.array(cues, pa.string()), pa.array(signs, pa.int32()), pa.array(weights, pa.int32())], fields=list(_SOFT.value_type))
        soft = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries)
        yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(batch.num_columns - 1)] + [soft], names=[*batch.schema.names[:-1], "soft"])


def hits(postings: DataFrame) -> DataFrame:
    """(posting_id, sentence_no, clause_no, k, clause, cue, polarity, weight) of every cue in clauses that are no questions."""
    found = clauses(postings).where("not interrogative")
    rows = found.select("posting_id", "sentence_no", "clause_no", "clause", constructions(F.col("clause")).alias("hard"), tokens(F.col("clause")).alias("words"))
    kind = rows.schema["posting_id"].dataType.simpleString()
    entry = "array<struct<k:int,cue:string,polarity:int,weight:int>>"
    both = rows.mapInArrow(_with_anchors, f"posting_id {kind}, sentence_no int, clause_no int, clause string, hard {entry}, soft {entry}")
    return both.select("posting_id", "sentence_no", "clause_no", "clause", F.explode(F.concat("hard", "soft")).alias("h")).select("posting_id", "sentence_no", "clause_no", "h.k", "clause", "h.cue", "h.polarity", "h.weight")


def signals(postings: DataFrame) -> DataFrame:
    """(posting_id, polarity, weight, evidence, cues): the heaviest cues decide, a tie is negative, nothing is `none`.

    posting_id may be of any type; repeated rows of an id are one posting.
    """
    entry = F.sort_array(F.collect_set(F.struct("sentence_no", "clause_no", "k", "clause", "cue", "polarity", "weight")))
    each = hits(postings).groupBy(F.col("posting_id").alias("_id")).agg(entry.alias("h"), F.max("weight").alias("weight"))
    decisive = F.filter("h", lambda x: x["weight"] == F.col("weight"))
    each = each.withColumn("sign", F.when(F.exists(decisive, lambda x: x["polarity"] < 0), -1).otherwise(1))
    agreeing = F.filter("h", lambda x: x["polarity"] == F.col("sign"))
    each = each.select("_id", F.when(F.col("sign") < 0, "negative").otherwise("positive").alias("polarity"), "weight", F.slice(F.array_distinct(agreeing["clause"]), 1, 3).alias("evidence"), F.array_distinct(agreeing["cue"]).alias("cues"))
    asked = postings.select("posting_id").distinct()
    rows = asked.join(each, asked["posting_id"].eqNullSafe(each["_id"]), "left")
    empty = F.array().cast("array<string>")
    return rows.select("posting_id", F.coalesce("polarity", F.lit("none")).alias("polarity"), F.coalesce("weight", F.lit(0)).alias("weight"), F.coalesce("evidence", empty).alias("evidence"), F.coalesce("cues", empty).alias("cues"))


def shown(histories: DataFrame, signal: DataFrame) -> DataFrame:
    """(posting_id, kind, shown): a posting that refuses is shown as such, whatever its employer's history is."""
    rows = histories.select("posting_id", "kind").join(signal.select("posting_id", "polarity"), "posting_id", "left")
    return rows.select("posting_id", "kind", F.when(F.col("polarity") == "negative", "posting_negative").otherwise(F.col("kind")).alias("shown"))
