"""Main text of web pages: parser events, text-to-tag ratios, smoothing, threshold clustering.

The standard library's parser streams a page's events. They build lines (blocks of
text), each with its container and its ratio of characters to tags. Parts that never
are an article (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles,
reader comments) are told by element, role or a class or id that says nothing else. The ratios
of the other lines are smoothed by a Gaussian; lines above the deviation of the ratios
are content. Content chooses the region: articles that hold some, else the smallest
container with nearly all of it, without those of its parts that hold none and are all links. A chosen
region is returned whole, short lines included. Names tell boxes only: headings are judged by none, and
paragraphs and what stands in a line by classes alone, as generators give ids made of their words to these.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import sliced

#: Element names, roles and words of class names of what isn't the article.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
SKIPPED = set("nav footer aside script style noscript template svg canvas iframe object button select option textarea dialog menu search head title audio video".split())
SKIPPED_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
COMMENT_NAMES = set("comment comments commentlist commentary disqus respond replies reply commenter".split())
#: Words that mean comments as a class; as an id they may name a part of the article.
COMMENT_CLASSES = COMMENT_NAMES | set("discussion discussions responses reactions feedback talkback".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup".split())
BOXES = set("div section aside nav article main header footer ul ol dl li table tbody tr td figure form fieldset details center blockquote iframe".split())
SKIPPED_NAMES = COMMENT_NAMES | set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar side nav navbar navigation menu breadcrumb breadcrumbs "
    "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription share sharing social related recommended recommendations "
    "footer header masthead login signup signin pagination pager toolbar widget widgets skip".split()
)
#: Words that say where or what kind of box, not what is in it.
NEUTRAL_NAMES = set(
    "area articles banner bar block by body bottom box btn button buttons col column container content count entry global google group holder icons id inner item items js left "
    "link links list main nav news page panel post posts primary reader readers right row secondary section sign site slot stories text thread to top up unit user users view wrap wrapper".split()
)
REGIONS = set("article main section div td body center blockquote form".split())
WHOLE = ("article", "main")
SOLID = set("p article main h1 h2 h3".split())
MOST = 0.8  # share of the content that the smallest container has to hold

_PART = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")
SIGMA = 1.5

KEPT, FORM, SKIP = 0, 1, 2  # a form goes too, unless the page stands in it


class Line(NamedTuple):
    text: str
    tags: int
    region: int  # nearest container
    whole: int  # outermost article or main, 0 if none
    form: int  # outermost form, 0 if none
    linked: bool  # nothing but links


def names_only(value: str, names: set[str]) -> bool:
    """One of the class names or ids in ``value`` holds words of ``names``, and besides them neutral ones at most."""
    for token in value.split():
        parts = {x.lower() for x in _PART.findall(token)}
        if parts & names and parts <= names | NEUTRAL_NAMES:
            return True
    return False


def kind(tag: str, attrs: list[tuple[str, str | None]], inside: bool) -> int:
    """What an element is by its own: KEPT, FORM or SKIP; ``inside`` an article or main."""
    if tag in SKIPPED or (tag == "header" and not inside):
        return SKIP
    if tag in ("html", "body"):
        return KEPT
    names = COMMENT_NAMES if tag in WHOLE else SKIPPED_NAMES - {"header", "side"} if inside else SKIPPED_NAMES
    found = FORM if tag == "form" else KEPT
    for name, value in attrs:
        value = value or ""
        low = value.lower()
        if name == "hidden" or (name == "aria-hidden" and low == "true") or (name == "style" and "display:none" in low.replace(" ", "")):
            return SKIP
        if name == "itemtype" and low.endswith("schema.org/comment"):
            return SKIP
        if (name == "class" and tag not in HEADINGS and names_only(value, names | COMMENT_CLASSES)) or (name == "id" and tag in BOXES and names_only(value, names)):
            return SKIP
        if name == "role" and low in SKIPPED_ROLES and tag not in WHOLE:
            return SKIP
    return found


class _Lines(HTMLParser):
    """Collects a page's lines and each container's parent."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool, int, int]] = []  # tag, region, skipped, whole, form
        self.open: Counter[str] = Counter()
        self.lines: list[Line] = []
        self.parents = [0]
        self.forms = self.tags = 0
        self.solid: set[int] = set()  # forms with paragraphs or headings
        self.parts: list[str] = []
        self.loose = False  # the line has text outside of links
        self.here: tuple[int, bool, int, int] = (0, False, 0, 0)

    def flush(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                region, _, whole, form = self.here
                self.lines.append(Line(text, max(1, self.tags), region, whole, form, not self.loose))
            self.parts = []
        self.tags, self.loose = 0, False

    def _pop(self, size: int) -> None:
        while len(self.stack) > size:
            self.open[self.stack.pop()[0]] -= 1
        self.here = self.stack[-1][1:] if self.stack else (0, False, 0, 0)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.parts.append(" ")
            elif tag == "hr":
                self.flush()
            return
        if tag in BLOCK:
            self.flush()
            self.tags += 1
            # a block ends an open paragraph and what that left open
            for i in range(len(self.stack) - 1, max(-1, len(self.stack) - 5), -1):
                if self.stack[i][0] == "p" and tag != "body":
                    self._pop(i)
                    break
            while tag in WHOLE and self.stack and self.stack[-1][0] in ("nav", "li", "ul") and self.stack[-1][2]:
                self._pop(len(self.stack) - 1)  # an article isn't part of a menu that nobody closed
        region, skipped, whole, form = self.here
        if tag in REGIONS:
            self.parents.append(region)
            region = len(self.parents) - 1
            if tag in WHOLE and not whole:
                whole = region
        what = SKIP if skipped else kind(tag, attrs, bool(whole))
        if what == FORM and not form:
            self.forms += 1
            form = self.forms
        if form and tag in SOLID:
            self.solid.add(form)
        self.here = (region, what == SKIP, whole, form)
        self.stack.append((tag, *self.here))
        self.open[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        self.tags += 1
        if self.open[tag]:  # else it closes nothing
            at = len(self.stack) - 1
            while self.stack[at][0] != tag:
                at -= 1
            self._pop(at)

    def handle_data(self, data: str) -> None:
        if not self.here[1]:
            self.parts.append(data)
            self.loose = self.loose or (not self.open["a"] and not data.isspace())


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """Means of the neighbours, weighted by a Gaussian; at the ends of those that there are."""
    reach = int(3 * SIGMA)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SIGMA) ** 2)
    inner = slice(reach, reach + len(ratios))
    return np.convolve(ratios, kernel)[inner] / np.convolve(np.ones(len(ratios)), kernel)[inner]


def _without_forms(lines: list[Line], solid: set[int]) -> list[Line]:
    """Lines outside of forms, and those of a form around most of a page's text, as some servers write pages."""
    size = Counter()
    for line in lines:
        size[line.form] += len(line.text)
    apart = any(line.whole and not line.form for line in lines)  # an article of its own
    around = {form for form in solid if not apart and 2 * size[form] > size.total()}
    return [line for line in lines if not line.form or line.form in around]


def _region(lines: list[Line], content: np.ndarray, parents: list[int]) -> list[Line]:
    """Lines of the smallest container that holds nearly all content, without those of its parts that hold none and are all links."""
    held = np.zeros(len(parents))
    for line, c in zip(lines, content, strict=True):
        if c:
            held[line.region] += len(line.text)
    for i in range(len(parents) - 1, 0, -1):  # a container has a greater number than its parent
        held[parents[i]] += held[i]
    root = 0
    for i in range(1, len(parents)):
        if parents[i] == root and held[i] >= MOST * held[0]:
            root = i
    part = [0] * len(parents)  # the part of the root that a container is in; 0: outside, -1: the root itself
    part[root] = -1
    for i in range(root + 1, len(parents)):
        part[i] = i if parents[i] == root else max(0, part[parents[i]])
    loose = {part[line.region] for line in lines if not line.linked}
    return [line for line in lines if (own := part[line.region]) == -1 or (own and (held[own] or own in loose))]


def main_text(html: str | None) -> str:
    """Blocks of the article of a page, joined by two line breaks; empty if there is none."""
    parser = _Lines()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    lines = _without_forms(parser.lines, parser.solid)
    if not lines:
        return ""
    ratios = np.array([len(line.text) / line.tags for line in lines])
    smooth = smoothed(ratios)
    content = smooth >= min(ratios.std(), smooth.max())
    inside = np.array([line.whole > 0 for line in lines])
    if inside.any():
        # articles that hold content; where none does, the one of the most text
        size = Counter()
        for line in lines:
            size[line.whole] += len(line.text) * bool(line.whole)
        chosen = {line.whole for line, c in zip(lines, content, strict=True) if c and line.whole} or {size.most_common(1)[0][0]}
        return "\n\n".join(line.text for line in lines if line.whole in chosen)
    return "\n\n".join(line.text for line in _region(lines, content, parser.parents))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages`` (page_id, url, html).

    Null and empty pages, and those without a line of text, give an empty text. Pages
    are parsed whole; nothing is cut. Repeated rows and rows without page_id return
    one each; an empty table gives an empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2):
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
