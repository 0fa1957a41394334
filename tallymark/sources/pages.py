"""Rendered job board pages as records: which board and kind a page is, its employer, title, text and key.

Address rules, cleaning of names and countries are columns; only reading the document is Python, in Arrow batches, and
only pages that a board claims get there. A step that finds nothing leaves its field null; a posting page without an
employer's name is not rendered yet and has no record.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from urllib.parse import parse_qs, urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names
from ..functions.dom import Page
from ..functions.places import infer_country

# fixed values: boards with their hosts, paths of a company and of postings, and what a description and a name must have
BOARDS = {"linkedin": ["www.linkedin.com", "linkedin.com"]}
BASE, DOMAIN = "https://www.linkedin.com", "linkedin.com"
COMPANY_PATH, JOBS_PATH, VIEW_PATH = r"^/company/([^/]+)", r"^/jobs(?:/|$)", r"^/jobs/view/([0-9]+)"
NAME_MOST, TEXT_LEAST = 120, 400
# fixed values: selectors of each field, tried in order
SELECTORS = {
    "root": ['[class*="jobs-search__job-details"]', '[class*="jobs-details"]', ".job-view-layout", "main"],
    "title": [".job-details-jobs-unified-top-card__job-title h1", ".job-details-jobs-unified-top-card__job-title", ".jobs-unified-top-card__job-title", ".top-card-layout__title", '[class*="job-title"] h1', '[class*="job-title"]', "h1.t-24"],
    "company": [".job-details-jobs-unified-top-card__company-name a", ".job-details-jobs-unified-top-card__company-name", ".jobs-unified-top-card__company-name a", ".jobs-unified-top-card__company-name", ".topcard__org-name-link", ".top-card-layout__second-subline a", '[class*="company-name"] a', '[class*="company-name"]'],
    "company_link": [".job-details-jobs-unified-top-card__company-name a", ".jobs-unified-top-card__company-name a", ".topcard__org-name-link", '[class*="company-name"] a[href*="/company/"]'],
    "description": [".jobs-description__content .jobs-box__html-content", ".jobs-description__content", "#job-details", ".jobs-box__html-content", ".description__text", ".show-more-less-html__markup", '[class*="jobs-description"]', '[class*="job-details"] [class*="html-content"]'],
    "location": [".job-details-jobs-unified-top-card__primary-description-container", ".jobs-unified-top-card__primary-description", ".jobs-unified-top-card__bullet", ".topcard__flavor--bullet", ".top-card-layout__second-subline", '[class*="primary-description"]', '[class*="tvm__text"]'],
    "org": [".org-top-card-summary__title", "h1.org-top-card-summary__title", ".top-card-layout__title"],
    "website": ['.org-top-card-primary-actions a[href^="http"]:not([href*="linkedin.com"])', ".org-about-module__company-page-url a", 'a.org-top-card-summary-info-list__info-item[href^="http"]'],
}
FIELDS = ["company", "slug", "title", "location", "description", "org", "website"]


def board(url: Column) -> Column:
    """The board whose host an address has, or null; a host that only looks like one has none."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.coalesce(*[F.when(host.isin(hosts), name) for name, hosts in BOARDS.items()])


def page_type(url: Column) -> Column:
    """company, job_posting or null, by the path."""
    path = F.try_parse_url(url, F.lit("PATH"))
    return F.when(path.rlike(COMPANY_PATH), "company").when(path.rlike(JOBS_PATH), "job_posting")


def company_slug(url: Column) -> Column:
    return F.nullif(F.regexp_extract(F.try_parse_url(url, F.lit("PATH")), COMPANY_PATH, 1), F.lit(""))


def job_key(url: Column, company: Column) -> Column:
    """The posting that is open, the one in the path, or the employer's name: the path of a search stays the same."""
    opened = F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit("currentJobId")))
    viewed = F.nullif(F.regexp_extract(F.try_parse_url(url, F.lit("PATH")), VIEW_PATH, 1), F.lit(""))
    return F.concat(F.lit("linkedin:job:"), F.coalesce(opened, viewed, company))


def _slug(href: str | None) -> str | None:
    try:
        parts = urlsplit(urljoin(BASE, href or "")).path.split("/")
    except ValueError:
        return None
    return parts[2] if len(parts) > 2 and parts[1] == "company" and parts[2] else None


def _website(href: str | None) -> str | None:
    """The host of a link, or of the address that a redirector carries."""
    try:
        link = urlsplit(href or "")
        if (link.hostname or "").endswith(DOMAIN):
            link = urlsplit(parse_qs(link.query).get("url", [""])[0])
        return link.hostname or None
    except ValueError:
        return None


def _named_link(page: Page, root: int) -> int | None:
    """The first link to a company's page with a short text: logos and lists of further postings have none."""
    for at in range(root + 1, page.last[root] + 1):
        if page.tags[at] == "a" and "/company/" in page.attrs[at].get("href", "") and len(page.text_of(at) or "") in range(1, NAME_MOST + 1):
            return at
    return None


def _longest_block(page: Page, root: int) -> int | None:
    """The article, section or div with the longest text that holds no article or section, if it is long enough.

    The text's first and last printed places are found once, so nested blocks do not read their text again.
    """
    outer, best, most = set(), None, TEXT_LEAST - 1
    for at, tag in enumerate(page.tags):
        if tag in ("article", "section"):
            up = page.parents[at]
            while up > 0 and up not in outer:
                outer.add(up)
                up = page.parents[up]
    printed = [i for i, c in enumerate(page.text) if not c.isspace()]
    begins, ends = _places(printed, page.starts), _places(printed, page.ends)
    for at in range(root + 1, page.last[root] + 1):
        if page.tags[at] in ("article", "section", "div") and at not in outer and begins[at] < ends[at]:
            size = printed[ends[at] - 1] - printed[begins[at]] + 1
            if size > most:
                best, most = at, size
    return best


def _places(printed: list[int], bounds: list[int]) -> list[int]:
    return [bisect_left(printed, b) for b in bounds]


def read_page(html: str | None) -> tuple:
    """The FIELDS of one document; a document that cannot be read has none."""
    try:
        page = Page(html or "")
    except (AssertionError, ValueError):  # what the parser raises on broken declarations
        return (None,) * len(FIELDS)
    root = page.first(SELECTORS["root"]) or 0

    def text(selectors: list[str]) -> str | None:
        """In the pane with the posting, then in the whole page."""
        for within in (root, 0):
            at = page.first(selectors, within)
            if at is not None and page.text_of(at):
                return page.text_of(at)
        return None

    link = _named_link(page, root)
    company = text(SELECTORS["company"]) or (page.text_of(link) if link is not None else None)
    shown = page.first(SELECTORS["company_link"])
    slug = (_slug(page.attrs[shown].get("href")) if shown is not None else None) or (_slug(page.attrs[link].get("href")) if link is not None else None)
    described = page.first(SELECTORS["description"])
    description = page.lines_of(described) if described is not None else None
    if description is None and company is not None:
        block = _longest_block(page, root)
        description = page.lines_of(block) if block is not None else None
    org, site = page.first(SELECTORS["org"]), page.first(SELECTORS["website"])
    return (
        company, slug, text(SELECTORS["title"]) or text(["h1"]), text(SELECTORS["location"]), description,
        page.text_of(org) if org is not None else None, _website(page.attrs[site].get("href")) if site is not None else None,
    )


#: Pages that are read before their fields are handed on: a batch's documents are never all strings at once.
READ = 64


def fields(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with its document `html` replaced by the document's FIELDS."""
    for b in batches:
        at = b.schema.get_field_index("html")
        rest = [i for i in range(b.num_columns) if i != at]
        for first in range(0, b.num_rows, READ):
            part = b.slice(first, READ)
            read = zip(*(read_page(x.as_py()) for x in part.column(at)), strict=True)
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in rest), *(pa.array(x, pa.string()) for x in read)], [*(b.schema.names[i] for i in rest), *(f"f_{name}" for name in FIELDS)])


def contexts(pages: DataFrame, *keep: str) -> DataFrame:
    """Records of the pages (url, html) that are a posting or a company: the columns `keep`, then board, page_type,
    company, slug, title, description, country, website and key. Null or odd addresses have no record; a null html is
    an empty page; repeated rows give repeated records."""
    claimed = pages.select(*keep, "url", "html", board(F.col("url")).alias("board"), page_type(F.col("url")).alias("page_type")).where("board is not null and page_type is not null")
    kind = claimed.drop("html").schema
    for name in FIELDS:
        kind = kind.add(f"f_{name}", T.StringType())
    read = claimed.mapInArrow(fields, kind).withColumn("f", F.struct(*[F.col(f"f_{name}").alias(name) for name in FIELDS]))
    posting, of_path = F.col("page_type") == "job_posting", company_slug(F.col("url"))
    name = F.when(posting, F.col("f.company")).otherwise(F.coalesce("f.org", names.deslugify(of_path)))
    found = read.where(~posting | F.col("f.company").isNotNull())
    return found.select(
        *keep, "board", "page_type", names.clean_company(name).alias("company"), F.when(posting, F.col("f.slug")).otherwise(of_path).alias("slug"),
        F.when(posting, F.col("f.title")).alias("title"), F.when(posting, F.col("f.description")).alias("description"), F.when(posting, infer_country(F.col("f.location"))).alias("country"),
        F.when(~posting, F.col("f.website")).alias("website"), F.when(posting, job_key(F.col("url"), F.col("f.company"))).otherwise(F.concat(F.lit("linkedin:company:"), of_path)).alias("key"),
    )


def field_rates(pages: DataFrame) -> DataFrame:
    """How many records of each kind hold each field: a selector that no longer hits shows here."""
    held = [F.count(c).alias(c) for c in ("slug", "title", "description", "country", "website")]
    return contexts(pages).groupBy("board", "page_type").agg(F.count("*").alias("n"), *held)
