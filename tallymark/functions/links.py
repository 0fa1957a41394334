"""Links to public searches and report forms, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
LEADERSHIP = ["/team", "/about/team", "/leadership", "/about/leadership", "/about", "/company/team"]
UNESCAPED = {"+": "%20", "%21": "!", "%27": "'", "%28": "(", "%29": ")", "%7E": "~"}


def component(c: Column) -> Column:
    """Percent-encodes a URL component: a space becomes %20, and a few marks that form encoding escapes stay."""
    out = F.url_encode(c)
    for mark, plain in UNESCAPED.items():
        out = F.replace(out, F.lit(mark), F.lit(plain))
    return out


def web_search(query: Column) -> Column:
    return F.concat(F.lit("https://www.google.com/search?q="), F.url_encode(query))


def site_search(site: str, query: Column) -> Column:
    return web_search(F.concat(F.lit(f"site:{site} "), query))


def interviews(company: Column) -> Column:
    """array of (label, url)."""
    quoted = F.concat(F.lit('"'), company, F.lit('"'))
    found = {
        "Glassdoor interviews": F.concat(F.lit("https://www.glassdoor.com/Search/results.htm?keyword="), component(company)),
        "Blind discussions": site_search("teamblind.com", F.concat(quoted, F.lit(" interview"))),
        "Interview write-ups on the web": web_search(F.concat(quoted, F.lit(" interview process questions"))),
    }
    return F.array(*[F.struct(F.lit(label).alias("label"), url.alias("url")) for label, url in found.items()])


def leadership_pages(domain: Column) -> Column:
    return F.transform(F.array(*map(F.lit, LEADERSHIP)), lambda path: F.concat(F.lit("https://"), domain, path))


def person_search(person: Column, company: Column) -> Column:
    return F.concat(F.lit("https://www.linkedin.com/search/results/people/?keywords="), F.url_encode(F.concat_ws(" ", person, company)))


# fixed values: whom to ask for a referral
ROLES = [("recruiter", "technical recruiter"), ("em", "engineering manager"), ("director", "director of engineering"), ("peer", "senior software engineer")]


def referrals(slug: Column, company: Column) -> Column:
    """array of (role, url): among a company's people if its page is known, else a search for its name."""
    people = lambda words: F.concat(F.lit("https://www.linkedin.com/company/"), F.url_encode(slug), F.lit("/people/?keywords="), F.url_encode(F.lit(words)))
    known = F.coalesce(slug, F.lit("")) != ""
    return F.array(*[F.struct(F.lit(role).alias("role"), F.when(known, people(words)).otherwise(person_search(company, F.lit(words))).alias("url")) for role, words in ROLES])


def mismatch_report(repository: str, queried: Column, matched: Column, page: Column, footer: str) -> Column:
    """A pre-filled issue about a wrong match; `footer` is the last line of its body."""
    title = F.concat(F.lit('Wrong match: "'), queried, F.lit('" → "'), matched, F.lit('"'))
    kind = F.when(page.contains("/company/"), "company page").otherwise("job posting")
    body = F.concat_ws(
        "\n",
        F.concat(F.lit("**Company name on the job board:** "), queried),
        F.concat(F.lit("**Name we matched it to:** "), matched),
        F.concat(F.lit("**Page type:** "), kind),
        *map(F.lit, ["", "**What is wrong:**", "<!-- e.g. this is a different company, or a subsidiary, or a staffing agency -->", "", "---", footer]),
    )
    return F.concat(F.lit(f"https://github.com/{repository}/issues/new?labels=entity-resolution&title="), F.url_encode(title), F.lit("&body="), F.url_encode(body))
