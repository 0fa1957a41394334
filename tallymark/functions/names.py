"""Organisation names as Column expressions: normalising, suffixes, acronyms, domains."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: legal-entity suffixes that are stripped from the end of a name
SUFFIXES = (
    "inc incorporated llc llp lp corp corporation co company ltd limited pc pllc plc cic cio lbg gmbh ag kg mbh se sa sas sarl sasu eurl bv nv sl slu sau srl spa snc pvt ab as asa oy oyj aps pty nz kk "
    "holdings holding group international worldwide global enterprises ventures partners associates"
).split() + ["gmbh co kg", "pvt ltd", "private limited", "pty ltd", "kabushiki kaisha", "co ltd"]
# fixed values: marks of a staffing intermediary, found anywhere in a normalised name
STAFFING = ["staffing", "staffing solutions", "consultancy", "consultants", "consulting services", "resourcing", "recruitment", "recruiting", "talent solutions", "manpower", "outsourcing", "it services", "technologies solutions", "workforce"]
# fixed values: what job boards append
BOARD_NOISE = r"(?i)\s*[|\-–—]\s*(?:careers?|jobs?|hiring|we[' ]?re hiring|official)\s*$"


def _decompositions() -> tuple[dict[str, str], dict[str, str]]:
    """What each character is in compatibility form without its combining marks, where that differs: one or no character,
    and several. Hangul syllables follow a rule instead."""
    one, many = {}, {}
    for point in range(0x80, sys.maxunicode + 1):
        c = chr(point)
        if 0xAC00 <= point <= 0xD7A3 or unicodedata.category(c) in ("Cn", "Co", "Cs"):
            continue
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if plain != c:
            (one if len(plain) < 2 else many)[c] = plain
    return one, many


_ONE, _MANY = _decompositions()
# translate() drops the characters that the second string is too short for
_FROM = "".join(sorted(_ONE, key=lambda c: not _ONE[c]))
_TO = "".join(_ONE[c] for c in _FROM)


def _class(characters) -> str:
    """A pattern's class of characters, as ranges of code points."""
    ranges: list[list[int]] = []
    for point in sorted(map(ord, characters)):
        if ranges and ranges[-1][1] == point - 1:
            ranges[-1][1] = point
        else:
            ranges.append([point, point])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]"


_SEVERAL = _class(_MANY)
# fixed values: Hangul syllables are leads, vowels and tails in a regular table
_LEADS, _VOWELS, _TAILS = ("".join(chr(first + i) for i in range(n)) for first, n in ((0x1100, 19), (0x1161, 21), (0x11A8, 27)))


def _expanded(character: Column) -> Column:
    """One character that stands for several."""
    at = F.ascii(character) - 0xAC00
    tail = F.when(at % 28 > 0, F.substr(F.lit(_TAILS), (at % 28).cast("int"), F.lit(1))).otherwise("")
    syllable = F.concat(F.substr(F.lit(_LEADS), F.floor(at / 588).cast("int") + 1, F.lit(1)), F.substr(F.lit(_VOWELS), F.floor(at % 588 / 28).cast("int") + 1, F.lit(1)), tail)
    table = F.map_from_arrays(F.lit(list(_MANY)), F.lit(list(_MANY.values())))
    return F.when(character.between("\uac00", "\ud7a3"), syllable).otherwise(F.coalesce(F.element_at(table, character), character))


def fold_accents(c: Column) -> Column:
    """The text in compatibility form (NFKD) without combining marks, for all scripts.

    Most characters stand for one or none, which one table says; texts with a character that stands for several, or with
    Hangul, are taken apart.
    """
    taken = F.array_join(F.transform(F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0)), _expanded), "")
    # the class has hundreds of ranges, so plain texts are told by one
    whole = F.when(c.rlike(r"[^\x00-\x7f]") & c.rlike(_SEVERAL + "|[\\x{ac00}-\\x{d7a3}]"), taken).otherwise(c)
    return F.translate(whole, _FROM, _TO)


def collapse_initialisms(c: Column) -> Column:
    """Runs of two or more one-character words become one word."""
    return F.regexp_replace(c, r"(?<=(?:^|\s)\S)\s(?=\S(?:\s|$))", "")


def strip_suffixes(c: Column) -> Column:
    """Drops suffix words from the end, never the first word."""
    alternatives = "|".join(sorted(SUFFIXES, key=lambda s: (-s.count(" "), s)))
    return F.regexp_replace(c, rf"^(\S+(?:\s\S+)*?)(?:\s(?:{alternatives}))+$", "$1")


def spaced(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize(c: Column) -> Column:
    text = fold_accents(F.regexp_replace(F.coalesce(c, F.lit("")), BOARD_NOISE, ""))
    text = F.regexp_replace(F.lower(text), r"\s*&\s*", " and ")
    return strip_suffixes(collapse_initialisms(spaced(F.regexp_replace(text, r"(?U)[^\w\s]", " "))))


def words(normalized: Column) -> Column:
    return F.when(normalized == "", F.array().cast("array<string>")).otherwise(F.split(normalized, " "))


def acronym(normalized: Column) -> Column:
    """Initials of two or more words, else empty. One pattern, so that the name is worked out once."""
    return F.regexp_replace(F.coalesce(normalized, F.lit("")), r"^[^ ]*\z|(?<=[^ ])[^ ]+| ", "")


def is_staffing(normalized: Column) -> Column:
    """One pattern of all marks, so that the name is worked out once and not for each mark."""
    return normalized.rlike("|".join(STAFFING))


def clean_domain(c: Column) -> Column:
    host = F.regexp_replace(F.regexp_replace(F.lower(F.btrim(c)), r"^[a-z][a-z0-9+.\-]*://", ""), r"^www\.", "")
    return F.nullif(F.split(host, "/")[0], F.lit(""))


def deslugify(c: Column) -> Column:
    return F.array_join(F.transform(F.filter(F.split(c, "-"), lambda x: x != ""), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.expr("''"), x.substr(F.lit(2), F.length(x)))), " ")


def to_int(c: Column) -> Column:
    """Cells of published sheets: commas go, blanks and placeholders are 0, fractions are cut off."""
    number = F.expr("null").cast("double") if c is None else F.regexp_replace(F.btrim(c), ",", "").try_cast("double")
    return F.when(number.isNull() | F.isnan(number) | (F.abs(number) > 9e15), F.lit(0)).otherwise(number).cast("long")


def clean_company(c: Column) -> Column:
    """A company's name as a page shows it, without counts, marks and its exact doubling."""
    text = F.btrim(F.regexp_replace(c, r"[\s\u00a0\ufeff]+", " "))
    text = F.regexp_replace(text, r"\s*·.*$", "")
    text = F.regexp_replace(text, r"(?i)\s*\d[\d,.]*\s*(followers?|employees?).*$", "")
    text = F.regexp_replace(text, r"(?i)\s*\(verified\)\s*$", "")
    return F.btrim(F.regexp_replace(text, r"^(.+) \1$", "$1"))
