"""The country that a location names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.phrases import ascii_edges

# fixed values: names of countries in order, then codes of states and provinces
COUNTRIES = [("united states|usa|u\\.s\\.a?\\.?|america", "US"), ("united kingdom|england|scotland|wales|northern ireland|u\\.k\\.?|uk", "GB"), ("canada", "CA"), ("india|bharat", "IN"), ("germany|deutschland", "DE"), ("ireland", "IE"), ("australia", "AU"), ("netherlands|holland", "NL"), ("singapore", "SG"), ("france", "FR"), ("spain", "ES"), ("switzerland", "CH"), ("sweden", "SE"), ("poland", "PL"), ("new zealand", "NZ"), ("japan", "JP"), ("brazil|brasil", "BR"), ("mexico", "MX"), ("united arab emirates|uae|dubai|abu dhabi", "AE")]
STATES = "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC".split()
PROVINCES = "AB BC MB NB NL NS NT NU ON PE QC SK YT".split()


def infer_country(c: Column) -> Column:
    """A country's name anywhere, else the first state or province code among the words."""
    out = None
    for pattern, code in COUNTRIES:
        hit = c.rlike(ascii_edges(rf"\b(?:{pattern})\b"))
        out = F.when(hit, code) if out is None else out.when(hit, code)
    codes = F.filter(F.transform(F.split(F.upper(c), r"[,\s]+"), lambda t: F.when(t.isin(STATES), F.lit("US")).when(t.isin(PROVINCES), F.lit("CA"))), lambda x: x.isNotNull())
    return out.otherwise(F.try_element_at(codes, F.lit(1)))


# fixed values: countries with a register, and their names
COVERED = {"US": "United States", "GB": "United Kingdom", "CA": "Canada"}


def has_register(code: Column) -> Column:
    return F.coalesce(code.isin(*COVERED), F.lit(False))


def country_label(code: Column) -> Column:
    """A country's name, or its code where no register is held."""
    return F.coalesce(*[F.when(code == k, v) for k, v in COVERED.items()], code)
