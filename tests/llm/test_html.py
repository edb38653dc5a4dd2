import html as entities
import re
import time

import duckdb
import pytest

from siltstone.llm import html

LONG = "Words of an article that go on for a while, with commas and a full stop."


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        (f"<nav><a>menu</a></nav><article><h1>T</h1><p>a &amp; b\n c<p>Sh.</p><p>{LONG}</article><footer>f</footer>", f"T\n\na & b c\n\nSh.\n\n{LONG}"),
        (f"<body><header>Site</header><div id=main-content><p>{LONG}<p>Short.</div><div class=sidebar>{LONG}</div><div class='comments'>{LONG}</div>", f"{LONG}\n\nShort."),
        (f"<nav>never closed <ul><li>x<article><p>{LONG}<script>var t='</p>'</script><form>send</form></article>", LONG),
        (f"<style>p{{}}</style><div class='cookie-notice'>{LONG}</div><main><p><b>{LONG}<br><p>End</main>", f"{LONG}\n\nEnd"),
        ("<p>only", "only"),
        # comments, also in article elements, go; names that only sound like boxes stay
        (f"<main><p>{LONG}</p><article class=comment>no</article><section id=comments><article>no</article></section></main>", LONG),
        (f"<article><p>{LONG}</p><div class='related-work'>work</div><section id=comment-on-law>law</section><div class='share-price'>9</div></article>", f"{LONG}\n\nwork\n\nlaw\n\n9"),
        (f"<article><p>{LONG}</p><div class='comment-list'>no</div><ul class='related-posts'><li>no</ul><div class=adsByGoogle>no</div><aside>no</aside></article>", LONG),
        # wrappers
        (f"<div class='layout has-sidebar'><div class=content-with-sidebar><p>{LONG}</p><p>b</p></div><div class=left-sidebar>no</div></div>", f"{LONG}\n\nb"),
        (f"<form action=x><div class=menu>no</div><p>{LONG}</p><p>b</p></form>", f"{LONG}\n\nb"),
        (f"<form><label>Name</label><input></form><p>{LONG}</p>", LONG),
        # no names at all: ratios choose
        (f"<div><a>one</a> <a>two</a> <a>three</a> <a>four</a></div><div><h1>T</h1><p>{LONG}<p>{LONG}<p>c</div><div><a>x</a><a>y</a><a>z</a><a>w</a></div>", f"T\n\n{LONG}\n\n{LONG}\n\nc"),
        # ids that a generator makes of a heading's words say nothing of a box; classes of headings neither
        (f"<article><h2 id=navigation>Navigation</h2><p>{LONG}</p><h2 id=related class=related>Related</h2><p id=notice>Note</p><p>b <span id=ad>c</span></p></article>", f"Navigation\n\n{LONG}\n\nRelated\n\nNote\n\nb c"),
        (f"<article><section id=discussion><h2>Discussion</h2><p>{LONG}</p></section><p class=advert>no</p><div id=related>no</div></article>", f"Discussion\n\n{LONG}"),
        (f"<main><p>{LONG}</p><div class='reader-responses'><p>no</p></div><div class=discussion>no</div><ul class='user-reactions'><li>no</ul></main>", LONG),
        # without an article: short parts of the container stay, those that are all links go
        (f"<div id=page><p>{LONG}<p>{LONG}<p>{LONG}<p>{LONG}<div><ul><li>one<li>two</ul></div><div>x</div><div><a href=a>p</a> <a href=b>q</a></div><p>{LONG}</div>", "\n\n".join([LONG] * 4 + ["one", "two", "x", LONG])),
        (f"<table><tr><td><a>home</a><td><h2 id=menu>Menu</h2><p>{LONG}<p>{LONG}<ul><li><b>k</b></ul></table>", f"Menu\n\n{LONG}\n\n{LONG}\n\nk"),
    ],
)
def test_main_text(page, text):
    assert html.main_text(page) == text


def test_ratios_choose_between_articles():
    teasers = "".join(f"<article><a>t</a><a>{i}</a><a>more</a></article>" for i in range(9))
    assert html.main_text(f"{teasers}<article>{f'<p>{LONG}</p>' * 9}<p>end</p></article>") == "\n\n".join([LONG] * 9 + ["end"])


def plain(page):
    """What the generated pages hold, by their known form alone."""
    inner = re.search(r"<article>(.*)</article>", page, re.S).group(1)
    blocks = re.split(r"</?(?:p|h1|h2|div|ul|li|blockquote)\b[^>]*>", inner)
    blocks = [" ".join(entities.unescape(re.sub(r"<br[^>]*>", " ", b).replace("<b>", "").replace("</b>", "")).split()) for b in blocks]
    return "\n\n".join(b for b in blocks if b)


def test_pages_as_a_plain_reader_reads_them():
    pages = [h for (h,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()]
    assert len(pages) > 100
    for page in pages:
        assert html.main_text(page) == plain(page)


def test_broken_pages_take_linear_time():
    start = time.process_time()
    for page in ("<b>x</i>" * 100_000, "<div>" * 50_000 + LONG, "</p>" * 100_000 + f"<p>{LONG}", "<p>x" * 50_000, "<table><tr><td>x" * 20_000):
        assert html.main_text(page)
    assert time.process_time() - start < 30


def test_rows(spark):
    rows = [(1, "u", f"<article><p>{LONG}</article>"), (None, None, None), (1, "u", f"<article><p>{LONG}</article>"), (2, "v", f"<article>{'<p>x</p>' * 20000}</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'t' as text")
    out = html.extract(df).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in out) == [(0, 0), (1, len(LONG)), (1, len(LONG)), (2, 59998)]
    assert html.extract(df.limit(0)).collect() == []
