"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks (the text between block-level tags). A classifier gives each block the odds of being content:
a logistic model over the block's text, its tag, an element for boilerplate around it, and how much of the names around
it (class, id, role) are words for boilerplate. Its weights are fitted on a bounded sample of pages with an article or main
element, whose blocks are told from all others of such a page; each block is learnt as it is, without its tag, and by its
text alone, so that no cue does the work of the others. A name that is boilerplate through and through (`ad`, `comment-list`)
is such a cue; one that holds such a word beside others starts with no weight, the pages say what it is worth. An
article or main element then shifts the odds of what is in it and of what is not. These odds are the capacities to the
two terminals. Neighbours in page order and blocks of one parent are tied by smoothness edges. The minimum cut then
labels all blocks of the page at once: a short line among paragraphs stays, an advert between them goes, and a paragraph
in a container with an odd name follows its own text and its neighbours.

Defined results: null and empty html give an empty text, as do pages without text; unclosed tags end where HTML
ends them; a page that breaks off within a tag, comment, script or style loses that part only; very long pages are
taken whole; repeated rows are extracted alike; blocks whose odds and ties are even are left out; an empty table gives no
rows; columns other than the id and the html are not read, whatever their names; elements hidden by an attribute are no
text.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

# fixed values: element names by their part in a page
BLOCKS = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "object", "canvas", "xmp", "noembed", "noframes", "head")
BOILER = set("nav aside footer form menu button select dialog header fieldset".split())
CONTENT = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# fixed values: words in class, id and role that mark boilerplate, and those that may stand for content too
MARKS = set(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disqus "
    "footer footnav gdpr login masthead menu menubar modal nav navbar navigation newsletter overlay pager pagination popup promo promotion promotions "
    "share sharing sidebar signup skip sponsor sponsored sponsors subscribe subscription tagcloud toolbar topbar widget widgets complementary contentinfo".split()
)
WEAK = set("alert byline dialog disclaimer form header notice notices notification recommended related replies reply respond search social".split())
# fixed values: words of names that say how an element is laid out, not what it is
NEUTRAL = set("area bar block body bottom box col column container content footer group header holder inner item items left link links list outer page panel right row section site slot text title top unit wrap wrapper".split())
#: Values are quoted only right behind the equals sign; any other quote is text.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_NAMES = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")


@dataclass(frozen=True)
class Inside:
    """What an element and those around it say of the text in them."""

    element: str = ""
    number: int = 0
    content: bool = False  # an article or main element
    boiler: bool = False  # an element for boilerplate
    whole: bool = False  # a name for boilerplate
    mark: float = 0.0  # how much of another name is for boilerplate
    weak: float = 0.0  # how much of a name may stand for either
    hidden: bool = False
    heading: bool = False
    named: str = ""  # the element's own attributes


@dataclass
class Block:
    tag: str
    named: str
    parent: int
    inside: Inside
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    @property
    def text(self) -> str:
        return " ".join(html.unescape("".join(self.parts)).split())


def _marks(attributes: str) -> tuple[bool, float, float, bool]:
    """Whether a name says boilerplate and nothing else; how much of one does, or perhaps does; whether it is hidden."""
    whole, mark, weak, hidden = False, 0.0, 0.0, False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value[1:-1] if value[:1] in ("'", '"') and value[-1:] == value[:1] else value
        if name in ("class", "id", "role"):
            for one in value.split():
                words = [w.lower() for w in _NAMES.split(one) if w and not w.isdigit()]
                marks, telling = sum(w in MARKS for w in words), [w for w in words if w in MARKS or w not in NEUTRAL | WEAK]
                if marks and marks == len(telling):
                    whole = True
                elif words:
                    mark = max(mark, marks / len(words))
                    weak = max(weak, sum(w in WEAK for w in words) / len(words))
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = True
    return whole, mark, weak, hidden


def _enter(around: Inside, name: str, attributes: str, number: int) -> Inside:
    whole, mark, weak, hidden = _marks(attributes) if name not in ("html", "body", "main") else (False, 0.0, 0.0, False)
    # a heading of an article's own header is part of the article
    boiler = name in BOILER and not (name == "header" and around.content)
    return Inside(name, number, around.content or name in CONTENT, around.boiler or boiler, around.whole or whole, max(around.mark, mark), max(around.weak, weak), around.hidden or hidden, around.heading or name in HEADINGS, attributes.strip())


def blocks(page: str) -> list[Block]:
    """The page's blocks with text, in page order."""
    out: list[Block] = []
    stack = [Inside()]
    seen, links, at, now = 0, 0, 0, None

    def write(text: str) -> None:
        nonlocal now
        if now is None:
            if not text.strip():
                return
            k = next(k for k in range(len(stack) - 1, -1, -1) if stack[k].element in BLOCKS or not k)
            now = Block(stack[k].element, stack[k].named, stack[max(0, k - 1)].number, stack[-1])
            out.append(now)
        now.parts.append(text)
        now.linked += len(text) if links else 0

    def close(k: int) -> None:
        nonlocal links, now
        for s in stack[k:]:
            links -= s.element == "a"
            if s.element in BLOCKS:
                now = None
        del stack[k:]

    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None:
            write(page[at:])
            break
        if m.start() > at:
            write(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].element == name), 0)
            if name in BLOCKS:
                now = None
            if k:
                close(k)
            continue
        if name in BLOCKS:
            now = None
            for k in range(len(stack) - 1, 0, -1):  # an open paragraph or item ends here
                open_ = stack[k].element
                if open_ == "p" or open_ == name == "li" or open_ in ("dt", "dd") and name in ("dt", "dd") or open_ in ("td", "th") and name in ("td", "th", "tr") or open_ == name == "tr" or open_ == name == "option":
                    close(k)
                    break
                if open_ in BLOCKS:
                    break
        if name == "br":
            if now is not None:
                now.parts.append("\n")
        elif name in VOID or m[3].rstrip().endswith("/"):
            continue
        elif name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            if name == "head" and not end:
                end = re.compile(r"<body\b", re.I).search(page, at)
                at = end.start() if end else len(page)
            else:
                at = end.end() if end else len(page)
        else:
            seen += 1
            stack.append(_enter(stack[-1], name, m[3], seen))
            links += name == "a"
    return [b for b in out if not b.inside.hidden and b.text]


#: Prior weights: one, log of words, share of linked text, punctuation a word, then paragraph, heading, list item or cell, then
#: element for boilerplate, name for boilerplate, part of a name, ambiguous part. What is only a part starts at zero.
PRIOR = np.array([-2.0, 0.5, -2.0, 1.0, 1.5, 1.0, -0.5, -10.0, -8.0, 0.0, 0.0])
FEATURES, TEXT, TAGS = len(PRIOR), slice(0, 4), slice(4, 7)
#: What the prior counts for: as much as so many blocks.
TRUST = 8.0
#: Shifts of the log odds in an article or main element, and outside of it on a page that has one.
WITHIN, WITHOUT = 1.5, -10.0
#: Log odds are held within this; ties of neighbours in page order, and of neighbours of one kind in one parent.
CLIP, ADJACENT, SIBLING = 15.0, 0.2, 2.0


def features(block: Block) -> list[float]:
    text, inside = block.text, block.inside
    words = text.split()
    n = max(1, len(text))
    own = [1.0, math.log1p(len(words)), min(1.0, block.linked / n), min(1.0, sum(c in ".,;:!?" for c in text) / max(1, len(words)))]
    tags = [float(block.tag in ("p", "pre", "blockquote")), float(inside.heading), float(block.tag in ("li", "td", "th"))]
    return [*own, *tags, float(inside.boiler), float(inside.whole), inside.mark, inside.weak]


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, ridge: float, rounds: int = 50) -> np.ndarray:
    """Newton steps, halved while they do not help, of a logistic regression around prior weights."""
    w = prior.copy()
    cost = lambda v: np.logaddexp(0, -(2 * y - 1) * (x @ v)).sum() + 0.5 * ridge * ((v - prior) ** 2).sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * (w - prior))
        while np.abs(step).max() > 1e-6 and cost(w + step) > cost(w):
            step /= 2
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_blocks(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of blocks with labels; each block counts as it is, without its tag, and by its text alone."""
    bare, text = x.copy(), np.zeros_like(x)
    bare[:, TAGS] = 0
    text[:, TEXT] = x[:, TEXT]
    return fit_logistic(np.concatenate([x, bare, text]), np.concatenate([y, y, y]), PRIOR, TRUST)


def fit(pages: DataFrame, *, column: str = "html", sample_pages: int = 400) -> np.ndarray:
    """Weights from about `sample_pages` pages that have an article or main element: its blocks against the others."""
    n = pages.count()
    part = F.pmod(F.xxhash64(F.col(column)), F.lit(1 << 30)) / float(1 << 30)
    rows = pages.where(part < min(1.0, sample_pages / max(1, n))).select(F.col(column).cast("string").alias("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = []
            for t in b.column("text").to_pylist():
                page = blocks(t or "")
                if any(k.inside.content for k in page):
                    found += [(features(k), float(k.inside.content and not k.inside.boiler)) for k in page]
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in found], pa.list_(pa.float64())), pa.array([y for _, y in found], pa.float64())], ["x", "y"])

    got = rows.mapInArrow(read, "x array<double>, y double").toArrow()
    if not got.num_rows:
        return PRIOR.copy()
    return fit_blocks(np.array(got.column("x").to_pylist()), got.column("y").to_numpy())


def min_cut(content: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost: -content[i] or 0 for each node, and each tie's weight if its ends differ. True: content.

    Dinic's algorithm over integer capacities; the source side of the minimum cut is content.
    """
    n = len(content)
    source, sink, scale = n, n + 1, 1 << 12
    to: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def tie(a: int, b: int, ab: int, ba: int) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((ab, ba))

    for i, c in enumerate(content):
        c = round(c * scale)
        if c > 0:
            tie(source, i, c, 0)
        elif c < 0:
            tie(i, sink, -c, 0)
    for a, b, w in ties:
        tie(a, b, round(w * scale), round(w * scale))
    while True:
        level = [-1] * (n + 2)
        level[source], queue = 0, [source]
        for u in queue:
            for e in out[u]:
                if room[e] > 0 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        next_ = [0] * (n + 2)
        path: list[int] = []
        u = source
        while True:
            if u == sink:
                push = min(room[e] for e in path)
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                k = next(i for i, e in enumerate(path) if room[e] == 0)
                u = to[path[k] ^ 1]
                del path[k:]
                continue
            while next_[u] < len(out[u]):
                e = out[u][next_[u]]
                if room[e] > 0 and level[to[e]] == level[u] + 1:
                    break
                next_[u] += 1
            if next_[u] < len(out[u]):
                path.append(out[u][next_[u]])
                u = to[path[-1]]
            elif u == source:
                break
            else:
                level[u] = -1
                u = to[path.pop() ^ 1]


def tied(found: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges of a page's blocks: neighbours in page order, and more between blocks of one kind in one parent."""
    ties: list[tuple[int, int, float]] = []
    last: dict[tuple, int] = {}
    for i, b in enumerate(found):
        if i:
            ties.append((i - 1, i, ADJACENT))
        kind = (b.parent, b.tag, b.named)
        if kind in last:
            ties.append((last[kind], i, SIBLING))
        last[kind] = i
    return ties


def odds(found: list[Block], weights: np.ndarray) -> np.ndarray:
    """Log odds of each block of a page being content."""
    own = np.array([features(b) for b in found]) @ weights
    within = np.array([b.inside.content for b in found])
    if within.any():
        own = own + np.where(within, WITHIN, WITHOUT)
    return np.clip(own, -CLIP, CLIP)


def labels(found: list[Block], weights: np.ndarray) -> list[bool]:
    """Which blocks of a page are content."""
    return min_cut(odds(found, weights).tolist(), tied(found))


def extract(page: str | None, weights: np.ndarray) -> str:
    found = blocks(page or "")
    return "\n\n".join(b.text for b, keep in zip(found, labels(found, weights), strict=True) if keep) if found else ""


def main_text(pages: DataFrame, weights: np.ndarray, *, id_column: str = "page_id", column: str = "html") -> DataFrame:
    """(page_id, text) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [extract(t, weights) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    rows = pages.select(pages[id_column].alias("id"), pages[column].cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_column)
