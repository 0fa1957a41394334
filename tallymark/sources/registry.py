"""The registers whose facts are held, what reads each of them, and loading a file by its source's id."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import registers

# fixed values: id, label, publisher, country, address, how often it is published
SOURCES = [
    ("us_petitions", "USCIS H-1B Employer Data Hub", "USCIS", "US", "https://www.uscis.gov/tools/reports-and-studies/h-1b-employer-data-hub", "annual"),
    ("us_certifications", "DOL OFLC PERM Disclosure Data", "US Department of Labor", "US", "https://www.dol.gov/agencies/eta/foreign-labor/performance", "quarterly"),
    ("us_conditions", "DOL OFLC LCA (H-1B) Disclosure Data", "US Department of Labor", "US", "https://www.dol.gov/agencies/eta/foreign-labor/performance", "quarterly"),
    ("uk_register", "UK Register of Licensed Sponsors: Workers", "UKVI", "GB", "https://www.gov.uk/government/publications/register-of-licensed-sponsors-workers", "daily"),
    ("ca_assessments", "Canada Positive LMIA Employers List", "ESDC", "CA", "https://open.canada.ca/data/en/dataset/90fed587-1364-4f33-a9ee-208181dc0b97", "quarterly"),
]
COLUMNS = "id string, label string, publisher string, country string, url string, cadence string"
#: What makes facts of a source's table, and how its header starts where a preamble may stand above it.
PARSERS = {"us_petitions": (registers.petitions, None), "uk_register": (registers.register, None), "ca_assessments": (registers.assessments, "employer")}


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SOURCES, T._parse_datatype_string(COLUMNS))


def source(source_id: str) -> dict[str, str]:
    """The entry of a source; an id that is not registered is an error before anything is read or written."""
    for row in SOURCES:
        if row[0] == source_id:
            return dict(zip(COLUMNS.replace(" string", "").split(", "), row, strict=True))
    raise KeyError(f"unknown source id {source_id!r}; known: {', '.join(r[0] for r in SOURCES)}")


def ingest(spark: SparkSession, source_id: str, path: str, published: str | datetime.date | None = None) -> DataFrame:
    """The facts of one published file, CSV or XLSX by its name, or of every file that matches a pattern's newest date.

    Without `published` the newest date in the file's name is taken; a file without one is an error, as each fact needs it.
    """
    source(source_id)
    if source_id not in PARSERS:
        raise NotImplementedError(f"no reader for {source_id!r}; readers: {', '.join(PARSERS)}")
    if published is None:
        newest = registers.discover(spark, path).where("published is not null").orderBy("published", "path", ascending=False).first()
        if newest is None:
            raise ValueError(f"no date in the name of {path!r} and none given")
        path, published = newest.path, newest.published
    parse, header = PARSERS[source_id]
    return parse(registers.read_table(spark, path, header), str(published))
