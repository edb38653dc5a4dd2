"""Web pages as rows: title, text, links with what stands around them."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import urls

_SILENT = {"script", "style", "svg", "canvas", "noscript", "template", "head"}
_BLOCK = {"p", "div", "li", "tr", "br", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "table", "ul", "ol", "footer", "header", "nav"}
SNAPSHOT = "title string, text string, links array<struct<href:string,anchor:string,heading:string,class:string>>"


class _Snapshot(HTMLParser):
    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.stack, self.text, self.title, self.links = base, [], [], [], []
        self.heading, self.link = "", None

    def handle_starttag(self, tag, attrs):
        own = dict(attrs)
        if tag in _BLOCK:
            self.text.append("\n")
        if tag == "a" and own.get("href"):
            near = next((c for _, c in reversed(self.stack) if c), "")
            self.link = [own["href"], [], near]
        if tag not in ("br", "img", "meta", "link", "input", "hr"):
            self.stack.append((tag, own.get("class") or ""))

    def handle_endtag(self, tag):
        if tag == "a" and self.link:
            self.links.append((urljoin(self.base, self.link[0].strip()), " ".join("".join(self.link[1]).split()), self.heading, self.link[2]))
            self.link = None
        if tag in _BLOCK:
            self.text.append("\n")
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                break

    def handle_data(self, data):
        tags = [t for t, _ in self.stack]
        if "title" in tags:
            self.title.append(data)
        if _SILENT & set(tags):
            return
        if tags and tags[-1] in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.heading = " ".join(data.split())
        if self.link:
            self.link[1].append(data)
        self.text.append(data)


def _snapshot(url: str | None, html: str | None) -> dict:
    parser = _Snapshot(url or "")
    parser.feed(html or "")
    parser.close()
    lines = (" ".join(line.split()) for line in "".join(parser.text).split("\n"))
    first: dict[str, tuple] = {}
    for link in parser.links:
        first.setdefault(link[0], link)
    links = [{"href": h, "anchor": a, "heading": n, "class": c} for h, a, n, c in first.values()]
    return {"title": " ".join("".join(parser.title).split()), "text": "\n".join(x for x in lines if x), "links": links}


SLICE = 1 << 20  # characters of pages that are parsed before their snapshots become Arrow
_ARROW = pa.struct([("title", pa.string()), ("text", pa.string()), ("links", pa.list_(pa.struct([(c, pa.string()) for c in ("href", "anchor", "heading", "class")])))])


def _parsed(urls_: pa.Array, htmls: pa.Array) -> pa.Array:
    """Snapshots of a batch; no more of them than of a slice are objects at a time."""
    done, own, size = [], [], 0
    for u, h in zip(urls_, htmls, strict=True):
        html = h.as_py()
        own.append(_snapshot(u.as_py(), html))
        size += len(html or "")
        if size >= SLICE:
            done.append(pa.array(own, _ARROW))
            own, size = [], 0
    return pa.concat_arrays([*done, pa.array(own, _ARROW)])


def snapshots(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` with title, text and links (in order, one a target), by an Arrow UDF over the standard parser."""
    return pages.withColumn("snapshot", F.arrow_udf(_parsed, SNAPSHOT)(url, html))


def link_signals(pages: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """A row for each link of each page: its identity, anchor, nearest heading, class, path depth, same site."""
    rows = snapshots(pages).select(key, url, F.posexplode("snapshot.links").alias("ordinal", "link"))
    target = urls.crawl_identity(F.col("link.href"))
    depth = F.size(F.filter(F.split(urls.part(F.col("link.href"), 3), "/"), lambda x: x != ""))
    return rows.select(key, url, "ordinal", target.alias("target"), "link.anchor", "link.heading", F.col("link.class").alias("near_class"), depth.alias("depth"), urls.same_site(F.col(url), F.col("link.href"), True).alias("same_site"))


def candidates(links: DataFrame, seen: DataFrame, key: str = "page_id") -> DataFrame:
    """``links`` with the reason why one isn't followed: already there, repeated on its page, offsite; null if it is."""
    known = seen.select(F.col("target")).distinct().withColumn("known", F.lit(True))
    again = F.row_number().over(Window.partitionBy(key, "target").orderBy("ordinal")) > 1
    reason: Column = F.when(F.coalesce("known", F.lit(False)), "enriched").when(again, "duplicate").when(~F.col("same_site"), "offsite").when(F.col("target").isNull(), "invalid")
    return links.join(known, "target", "left").withColumn("dropped", reason).drop("known")
