"""What is let through: requests, responses, pages and texts, each with the reason why not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: shortest texts and longest fields
NAME_MOST, DOMAIN_MOST, RESUME_LEAST, DESCRIPTION_LEAST, EMBEDDED_MOST = 300, 255, 50, 200, 4000


def request_fault(name: Column, country: Column, domain: Column) -> Column:
    """Which field of a lookup is not acceptable, or null."""
    length = lambda c: F.char_length(c)
    return (
        F.when(name.isNull() | ~length(name).between(1, NAME_MOST), "name")
        .when(length(country) != 2, "country")
        .when(length(domain) > DOMAIN_MOST, "domain")
    )


def split_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (name, country, domain), and the rejected ones with their fault."""
    judged = requests.withColumn("fault", request_fault(F.col("name"), F.col("country"), F.col("domain")))
    return judged.where("fault is null").drop("fault"), judged.where("fault is not null")


def verdict_fault(kind: Column, matched: Column, records: Column, queried: Column, sources: Column) -> Column:
    """Why a verdict cannot be shown, or null. `records` is an array of arrays of sources: one without a source is not shown."""
    bare = F.exists(records, lambda r: r.isNull() | (F.size(r) == 0))
    odd = F.lit("unexpected response")
    return (
        F.when(kind == "verified", F.when(matched.isNull() | records.isNull(), odd).when(bare, "data without a source"))
        .when(kind == "no_record", F.when(queried.isNull(), odd))
        .when(kind == "does_not_sponsor", F.when(matched.isNull() | sources.isNull(), odd))
        .when(kind == "error", F.lit(None).cast("string"))
        .otherwise(odd)
    )


def match_reason(enabled: Column, resume: Column, description: Column) -> Column:
    """Why a resume is not compared with a posting, or null."""
    long = F.char_length(F.regexp_replace(F.coalesce(description, F.lit("")), r"^[\s ﻿]+|[\s ﻿]+$", "")) >= DESCRIPTION_LEAST
    return F.when(~F.coalesce(enabled, F.lit(False)), "disabled").when(resume.isNull(), "no_resume").when(~long, "no_description")


def comparable_page(page_type: Column, description: Column) -> Column:
    return (page_type == "job_posting") & (F.coalesce(description, F.lit("")) != "")


def resume_long_enough(text: Column) -> Column:
    return F.char_length(F.btrim(F.coalesce(text, F.lit("")))) >= RESUME_LEAST


def safe_url(url: Column) -> Column:
    """https, or http on the machine itself."""
    scheme, host = F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))), F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.coalesce(host.isNotNull() & ((scheme == "https") | ((scheme == "http") & host.isin("localhost", "127.0.0.1"))), F.lit(False))


def for_embedding(text: Column, most: int = EMBEDDED_MOST) -> Column:
    """White space collapsed, and what a small model reads of a long text."""
    return F.substring(F.btrim(F.regexp_replace(text, r"[\s ﻿]+", " ")), 1, most)
