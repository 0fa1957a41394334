from tallymark.functions import dom
from tallymark.sources import pages

SITE = "https://www.linkedin.com"


def guest_page(firm="Tidewater Ferries", slug="tidewater-ferries", title="Harbour pilot", place="Leeds, England, United Kingdom", body=""):
    """A posting as it is shown to guests, in a layout of sections."""
    return f"""<html><body><header><a href="/company/menu-entry">Menu</a></header><article><section class="two-pane top-card-layout">
    <figure><a href="{SITE}/company/{slug}?trk=logo"><img alt=""></a></figure><h2 class="top-card-layout__title">{title}</h2>
    <h4><span><a class="topcard__org-name-link" href="{SITE}/company/{slug}?trk=name"> {firm} </a></span><span class="topcard__flavor--bullet">{place}</span></h4>
    </section><section class="core"><div class="show-more-less-html__markup">{body}</div></section></article></body></html>"""


BODY = "<p>Steer the night boats.<br>Report to the quay.</p><script>track()</script><ol><li>Sea legs &amp; patience</li><li>A&nbsp;licence</li></ol>"
PLAIN = "Twelve boats, four quays and one crew that knows the river better than any chart does. " * 6


def unknown_layout(firm, slug):
    """None of the known names: the employer is the first link to a company with a short text, the text the longest block."""
    return f"""<main><section><h1>Boatswain</h1><p><a href="/company/{slug}"><svg></svg></a><a href="/company/other-firm">{"x" * 130}</a><a href="/company/{slug}/people">{firm}</a></p>
    </section><section><div><div>Short note</div></div><div><p>{PLAIN}</p></div></section></main><footer><a href="/company/last">Last</a></footer>"""


def found(spark, *rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, url string, html string")
    return {r.id: r for r in pages.contexts(df, "id").collect()}


def test_a_posting_as_guests_see_it(spark):
    got = found(spark, (f"{SITE}/jobs/view/77001?refId=a", guest_page(body=BODY)))[0]
    assert (got.board, got.page_type, got.key) == ("linkedin", "job_posting", "linkedin:job:77001")
    assert (got.company, got.slug, got.title, got.country) == ("Tidewater Ferries", "tidewater-ferries", "Harbour pilot", "GB")
    assert got.description.split("\n") == ["Steer the night boats.", "Report to the quay.", "Sea legs & patience", "A licence"] and got.website is None


def test_a_posting_in_an_unknown_layout(spark):
    got = found(spark, (f"{SITE}/jobs/collections/x/?currentJobId=88", unknown_layout("North Quay", "north-quay")))[0]
    assert (got.company, got.slug, got.title, got.key) == ("North Quay", "north-quay", "Boatswain", "linkedin:job:88")
    assert got.description == f"Short note\n{PLAIN.strip()}"


def test_which_addresses_are_records(spark):
    page = guest_page()
    rows = {
        "posting": (f"{SITE}/jobs/view/5", page), "search": ("https://linkedin.com/jobs", page), "company": (f"{SITE}/company/dry-dock--works/life", None),
        "list": (f"{SITE}/jobs/search/", "<main><ul><li>Result</li></ul></main>"), "other host": ("https://linkedin.com.example/jobs/view/5", page), "odd": ("not an address", page),
        "null": (None, page), "feed": (f"{SITE}/feed", page), "broken": (f"{SITE}/jobs/view/6", "<main " * 3 + "<![x"),
    }
    got = {list(rows)[i]: r for i, r in found(spark, *rows.values()).items()}
    assert set(got) == {"posting", "search", "company"}
    assert got["search"].key == "linkedin:job:Tidewater Ferries" and got["posting"].description is None
    assert (got["company"].company, got["company"].slug, got["company"].key) == ("Dry Dock Works", "dry-dock--works", "linkedin:company:dry-dock--works")


def test_counts_beside_a_name_go(spark):
    got = found(spark, (f"{SITE}/jobs/view/1", guest_page(firm="Tidewater Ferries · 3,400 followers")), (f"{SITE}/jobs/view/2", guest_page(firm="Tidewater Ferries 250 employees")))
    assert [r.company for r in got.values()] == ["Tidewater Ferries"] * 2


def test_empty(spark):
    assert found(spark, (f"{SITE}/feed/", "")) == {}
    assert pages.contexts(spark.createDataFrame([], "url string, html string")).collect() == []


def test_repeated_and_clashing(spark):
    df = spark.createDataFrame([(f"{SITE}/jobs/view/1", guest_page(), "x")] * 2, "url string, html string, company string")
    assert [r.company for r in pages.contexts(df).collect()] == ["Tidewater Ferries"] * 2


def test_selectors():
    page = dom.Page('<div id=a class="x y"><p class=z data-q="1">one<br>two<p>three</div><pre>a\nb</pre><a href="http://l.com/">l</a><a href="http://m.com">m</a>')
    tag = lambda s: None if page.find(s) is None else page.text_of(page.find(s))
    assert tag("#a .z") and tag("div.x.y p") and tag("#b") is None and tag(".z div") is None
    assert tag('a[href^="http"]:not([href*="l.com"])') == "m" and tag("[data-q]") == tag('p[data-q="1"]')
    assert page.lines_of(page.find("#a")) == "one\ntwo\nthree" and page.lines_of(page.find("pre")) == "a\nb"
    assert page.first(["a:hover", "a >", "pre"]) == page.find("pre")


def test_deep_page():
    deep = "<div>" * 20000 + PLAIN
    page = dom.Page(f"<main>{deep}</main>")
    assert page.text_of(pages._longest_block(page, page.find("main"))) == PLAIN.strip()


def test_address_of_website():
    assert pages._website(f"{SITE}/redir?url=https%3A%2F%2Fwww.quay.example%2F") == "www.quay.example"
    assert pages._website("https://quay.example/about") == "quay.example" and pages._website("https://www.linkedin.com/redir") is None and pages._website("http://[x") is None
