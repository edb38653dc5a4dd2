"""Pages without structural noise: footers, headers, drawings and styles cut out of their source.

A page is parsed once to its elements with where each begins and ends. Descendants are counted bottom-up, so a header that
holds half of the page, as some sites write them, stays. What is left keeps its very source.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What footers and headers are called, as a whole name or as a part of one, and the share of a page at which a header is its body.
FOOTER = (set("footer foot copyright copy-right site-footer page-footer".split()), set("footer foot copyright copy-right".split()), "contentinfo")
HEADER = (set("header head site-header page-header topbar top-bar nav-header".split()), set("header topbar top-bar".split()), "banner")
DRAWN = {"svg", "style", "canvas"}
SWALLOWED = 0.5

_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_CASE = re.compile(r"([a-z0-9])([A-Z])")
_OTHER = re.compile(r"[^a-z0-9]+")


class _Elements(HTMLParser):
    """Elements in order: [tag, attributes, parent, begin, end]. What nobody closes ends with its parent."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=False)
        self.page, self.found, self.open = page, [], []
        self.lines = [0]
        for at in re.finditer("\n", page):
            self.lines.append(at.end())

    def here(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def handle_starttag(self, tag, attrs):
        self._add(tag, attrs, tag in _VOID)

    def handle_startendtag(self, tag, attrs):
        self._add(tag, attrs, True)

    def _add(self, tag, attrs, closed):
        begin = self.here()
        self.found.append([tag, dict(attrs), self.open[-1] if self.open else -1, begin, begin + len(self.get_starttag_text())])
        if not closed:
            self.open.append(len(self.found) - 1)

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            if self.found[self.open[depth]][0] == tag:
                begin = self.here()
                close = self.page.find(">", begin)
                end = len(self.page) if close < 0 else close + 1
                for i in self.open[depth + 1 :]:
                    self.found[i][4] = begin
                self.found[self.open[depth]][4] = end
                del self.open[depth:]
                return

    def read(self) -> list[list]:
        self.feed(self.page)
        self.close()
        for i in self.open:
            self.found[i][4] = len(self.page)
        return self.found


def named(value: str | None, names: set[str], parts: set[str]) -> bool:
    """The first of the names in a class or id says so, as a whole or by one of its words."""
    first = (value or "").split()[:1]
    if not first:
        return False
    plain = _OTHER.sub("-", _CASE.sub(r"\1-\2", first[0]).lower()).strip("-")
    is_in = lambda x, known: x in known or x.replace("-", "") in known
    return bool(plain) and (is_in(plain, names) or any(is_in(x, parts) for x in plain.split("-")))


def is_noise(tag: str, attrs: dict, rule: tuple) -> bool:
    names, parts, role = rule
    own = "footer" if rule is FOOTER else "header"
    return tag == own or (attrs.get("role") or "").lower() == role or named(attrs.get("id"), names, parts) or named(attrs.get("class"), names, parts)


def stripped(page: str, header: bool = True, overlays: tuple[str, ...] = ()) -> tuple[str, int]:
    """A page without noise, and how many elements went, those inside of others not counted. ``overlays``: ids of elements that go, too."""
    elements = _Elements(page).read()
    gone = [False] * len(elements)
    cut: list[tuple[int, int]] = []

    def remove(noise) -> None:
        for i, (tag, attrs, parent, begin, end) in enumerate(elements):
            if gone[i] or (parent >= 0 and gone[parent]):
                gone[i] = True
            elif noise(i, tag, attrs):
                gone[i] = True
                cut.append((begin, end))

    remove(lambda i, tag, attrs: attrs.get("id") in overlays if attrs.get("id") else False)
    remove(lambda i, tag, attrs: tag in DRAWN)
    root = next((i for i, e in enumerate(elements) if e[0] == "html"), None)
    remove(lambda i, tag, attrs: i != root and is_noise(tag, attrs, FOOTER))
    if header:
        inner = [0] * len(elements)
        for i in range(len(elements) - 1, -1, -1):  # children stand behind their parents
            if not gone[i] and elements[i][2] >= 0:
                inner[elements[i][2]] += inner[i] + 1
        total = inner[root] if root is not None else len(elements) - sum(gone)
        remove(lambda i, tag, attrs: i != root and is_noise(tag, attrs, HEADER) and not (total and inner[i] / total >= SWALLOWED))
    whole: list[tuple[int, int]] = []
    for begin, end in sorted(cut):  # what went first may stand in what went later
        if not whole or begin >= whole[-1][1]:
            whole.append((begin, end))
    kept, at = [], 0
    for begin, end in whole:
        kept.append(page[at:begin])
        at = end
    return "".join([*kept, page[at:]]), len(whole)


def without_noise(html: Column, header: bool = True, overlays: tuple[str, ...] = ()) -> Column:
    """(html, removed): pages without footers, headers, drawings and styles. A null page is an empty one."""

    @F.arrow_udf("struct<html:string,removed:int>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            rows = (stripped(x.as_py() or "", header, overlays) for x in part)  # a page at a time
            yield pa.array([{"html": h, "removed": n} for h, n in rows], pa.struct([("html", pa.string()), ("removed", pa.int32())]))

    return run(html)
