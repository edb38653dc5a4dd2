import random
import time

import duckdb
from pyspark.sql import functions as F

from siltstone.functions import noise

NAMES = ["footer", "siteFooter", "page_header", "head", "content header", "wrapper header", "main", "top-bar", "Copy-Right x", "headline", "footnote", "navHeader", ""]


def drawn(draw, depth):
    """A tree: (tag, attributes, children), texts as strings."""
    tag = draw.choice(["div", "div", "section", "p", "footer", "header", "svg", "span", "style"])
    attrs = {k: draw.choice(v) for k, v in (("class", NAMES), ("id", [*NAMES, "own-overlay"]), ("role", ["banner", "contentinfo", "main"])) if draw.random() < 0.25}
    inner = [] if tag == "style" else [drawn(draw, depth - 1) if depth and draw.random() < 0.7 else f"t{draw.randrange(99)} &amp; " for _ in range(draw.randrange(5))]
    return tag, attrs, inner


def written(x):
    if isinstance(x, str):
        return x
    return f"<{x[0]}{''.join(f' {k}="{v}"' for k, v in x[1].items())}>{''.join(map(written, x[2]))}</{x[0]}>"


def count(x):
    return 0 if isinstance(x, str) else sum(1 + count(c) for c in x[2] if not isinstance(c, str))


def plain(html, header=True):
    """The rules on a tree, each count taken anew."""

    def pruned(x, test):
        return x if isinstance(x, str) else (x[0], x[1], [pruned(c, test) for c in x[2] if isinstance(c, str) or not test(c)])

    html = pruned(html, lambda c: c[1].get("id") == "own-overlay")
    html = pruned(html, lambda c: c[0] in ("svg", "style", "canvas"))
    html = pruned(html, lambda c: noise.is_noise(c[0], c[1], noise.FOOTER))
    total = count(html)
    return pruned(html, lambda c: noise.is_noise(c[0], c[1], noise.HEADER) and count(c) / total < 0.5) if header and total else html


def test_random_pages_keep_what_the_rules_keep():
    draw, changed = random.Random(3), 0
    for i in range(400):
        html = ("html", {"class": "header"} if i % 3 == 0 else {}, [("body", {}, [drawn(draw, 4) for _ in range(3)])])
        for header in (True, False):
            page, n = noise.stripped("<!doctype html>\n" + written(html), header, ("own-overlay",))
            assert page == "<!doctype html>\n" + written(plain(html, header))
            changed += n > 0
    assert changed > 200


def test_a_header_around_the_page_stays_and_broken_pages_end():
    body = "<p>x</p>" * 9
    assert noise.stripped(f"<html><body><header>{body}</header><p>y</p></body></html>") == (f"<html><body><header>{body}</header><p>y</p></body></html>", 0)
    assert noise.stripped(f"<html><body><header><p>m</p></header>{body}</body></html>") == (f"<html><body>{body}</body></html>", 1)
    assert noise.stripped("<footer>never closed <p>x") == ("", 1) and noise.stripped("</div><br/>x") == ("</div><br/>x", 0)
    began = time.process_time()
    for page in ("<div>" * 20_000, "<p>x" * 50_000, "</b>" * 50_000, "<header>" * 5_000 + "x", "\n<a>" * 50_000):
        noise.stripped(page)
    assert time.process_time() - began < 30


def test_columns(spark):
    pages = [h for (h,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.001/pages.parquet'").fetchall()] + [None]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(pages)], "i long, h string")
    got = {r.i: tuple(r.s) for r in df.select("i", noise.without_noise(F.col("h")).alias("s")).collect()}
    assert got == {i: noise.stripped(h or "") for i, h in enumerate(pages)} and got[len(pages) - 1] == ("", 0)
