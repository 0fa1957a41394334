"""A small document tree for Arrow batches of pages: elements in page order in flat lists, and simple selectors.

An element's descendants are the elements behind it up to `last`, and its text is one stretch of the page's text, so
nothing recurses and nested elements share their text. Text of scripts and styles is left out. Selectors are compounds
of a tag, #id, .class, [name], [name="v"], [name*="v"], [name^="v"] and :not(...) with descendant combinators; any other
one raises ValueError, which `first` takes as no hit.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from functools import cache
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table td th tr ul".split())
SILENT = frozenset(["script", "style"])
_PART = re.compile(r"""(?P<tag>[a-z][a-z0-9]*|\*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[(?P<name>[\w-]+)(?:(?P<op>[*^]?=)"(?P<value>[^"]*)")?\]|:not\((?P<no>[^()]*)\)""")


class Page(HTMLParser):
    """tags, attributes, parents, text bounds and last descendants of a page's elements; element 0 is the page."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tags, self.attrs, self.parents, self.starts, self.ends, self.last = [""], [{}], [-1], [0], [0], [0]
        self.pieces, self.length, self.breaks, self.open = [], 0, [], [0]
        self.feed(html)
        self.close()
        self._shut(0)
        self.text = "".join(self.pieces)

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS or tag == "br":
            self.breaks.append(self.length)
        at = len(self.tags)
        self.tags.append(tag)
        self.attrs.append({k: v or "" for k, v in reversed(attrs)})  # the first of equal names counts
        self.parents.append(self.open[-1])
        self.starts.append(self.length)
        self.ends.append(self.length)
        self.last.append(at)
        if tag not in VOID:
            self.open.append(at)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, 0, -1):
            if self.tags[self.open[depth]] == tag:
                self._shut(depth)
                return

    def handle_data(self, data):
        inside = self.tags[self.open[-1]]
        if inside in SILENT:
            return
        if inside == "pre":
            self.breaks.extend(self.length + m.start() for m in re.finditer(r"\r\n?|\n", data))
        self.pieces.append(data)
        self.length += len(data)

    def _shut(self, depth: int) -> None:
        """Closes the open elements from `depth` on."""
        for at in self.open[depth:]:
            self.ends[at], self.last[at] = self.length, len(self.tags) - 1
            if self.tags[at] in BLOCKS:
                self.breaks.append(self.length)
        del self.open[depth:]

    def text_of(self, at: int) -> str | None:
        """White space collapsed; none if nothing is left."""
        return " ".join(self.text[self.starts[at] : self.ends[at]].split()) or None

    def lines_of(self, at: int) -> str | None:
        """One line for each block or line break that holds text."""
        start, end = self.starts[at], self.ends[at]
        inner = sorted({start, end, *self.breaks[bisect_left(self.breaks, start) : bisect_right(self.breaks, end)]})
        lines = (" ".join(self.text[a:b].split()) for a, b in zip(inner, inner[1:], strict=False))
        return "\n".join(x for x in lines if x) or None

    def find(self, selector: str, root: int = 0) -> int | None:
        """The first descendant of `root` that a selector hits; its ancestors may stand above `root`."""
        steps = compiled(selector)
        return next((at for at in range(root + 1, self.last[root] + 1) if self._hit(at, steps)), None)

    def first(self, selectors: list[str], root: int = 0) -> int | None:
        """The element of the first selector that hits; selectors that cannot be read are passed over."""
        for selector in selectors:
            try:
                at = self.find(selector, root)
            except ValueError:
                continue
            if at is not None:
                return at
        return None

    def _hit(self, at: int, steps: tuple) -> bool:
        if not self._is(at, steps[-1]):
            return False
        for step in reversed(steps[:-1]):
            at = self.parents[at]
            while at > 0 and not self._is(at, step):
                at = self.parents[at]
            if at <= 0:
                return False
        return True

    def _is(self, at: int, tests: tuple) -> bool:
        attrs = self.attrs[at]
        for kind, name, value in tests:
            if kind == "tag":
                hit = name in ("*", self.tags[at])
            elif kind == "cls":
                hit = name in attrs.get("class", "").split()
            elif kind == "not":
                hit = not self._is(at, value)
            else:
                has = attrs.get(name)
                hit = has is not None and (kind == "has" or (kind == "=" and has == value) or (value != "" and ((kind == "*=" and value in has) or (kind == "^=" and has.startswith(value)))))
            if not hit:
                return False
        return True


@cache
def compiled(selector: str) -> tuple:
    """The compounds of a selector, each a tuple of tests."""
    return tuple(_compound(part) for part in re.findall(r"""(?:"[^"]*"|[^\s"])+""", selector)) or _refuse(selector)


def _compound(text: str) -> tuple:
    tests, at = [], 0
    while at < len(text):
        m = _PART.match(text, at)
        if not m or (m["tag"] and at):
            _refuse(text)
        if m["tag"]:
            tests.append(("tag", m["tag"], ""))
        elif m["id"]:
            tests.append(("=", "id", m["id"]))
        elif m["cls"]:
            tests.append(("cls", m["cls"], ""))
        elif m["name"]:
            tests.append((m["op"] or "has", m["name"], m["value"] or ""))
        else:
            tests.append(("not", "", _compound(m["no"])))
        at = m.end()
    return tuple(tests)


def _refuse(text: str):
    raise ValueError(f"no selector of the kind that is understood: {text!r}")
