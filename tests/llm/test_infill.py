import hashlib
import re

import pytest

from siltstone.llm import infill


def plain(doc_id, text, rate=100, spm=50, seed=7):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = [None, "", "\n", "\n\n\n", "one", "one\n", "a\nb\r\nc", "é😀\n漢字 x\n\x00\n", "<P>", "x<S", "<<\n<P\n<\n>", "has <M> inside\nline", "tail\n" * 50, "<S\n" * 9, "\x85\n\x0c\n "]


def made(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'n' AS n", "1 AS first", "'o' AS output", "2 AS h1")
    out = infill.fill_in_middle(df, **options)
    return out.select("*", infill.restored(out.output, out.form).alias("again")).collect()


@pytest.mark.parametrize("options", [{}, {"rate": 40, "spm": 10}, {"spm": 100}, {"spm": 0, "seed": 3}])
def test_against_plain(spark, options):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(90)] + [(5, "again\nand\nagain"), (5, "again\nand\nagain"), (None, "no\nid\n"), (-4, "x\ny")]
    got = made(spark, rows, **options)
    assert sorted(map(repr, (tuple(r)[:6] for r in got))) == sorted(map(repr, (plain(*r, **options) for r in rows)))
    texts = sorted(t or "" for _, t in rows)
    assert sorted(r.again for r in got) == texts
    if not options:
        assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_very_long_and_empty(spark):
    rows = [(1, "line of text\n" * 300_000), (2, "x" * 5_000_000), (3, "\n" * 200_000)]
    got = {r.doc_id: r for r in made(spark, rows)}
    assert all(tuple(got[i])[:6] == plain(i, t) and got[i].again == t for i, t in rows)
    assert made(spark, []) == []


def test_marks_that_could_not_be_read_back_are_refused(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    for marks in (("<P>", "<P>", "<M>"), ("<<", "<S>", "<M>"), ("", "<S>", "<M>"), ("P>", "S>P", "M")):
        with pytest.raises(ValueError):
            infill.fill_in_middle(df, marks=marks)
    other = ("[1", "{2", "(3")
    out = infill.fill_in_middle(spark.createDataFrame([(i, "a\nb<P>\nc") for i in range(30)], "doc_id long, text string"), marks=other)
    got = out.select("form", infill.restored(out.output, out.form, other).alias("t")).collect()
    assert {r.t for r in got} == {"a\nb<P>\nc"} and {r.form for r in got} == {"psm", "spm"}


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_slices_cut_no_unit(monkeypatch, size):
    monkeypatch.setattr(infill, "SLICE", size)
    for text in [*filter(None, TEXTS), "\n" * 5 + "ab" + "\n" * 2 + "é😀c"]:
        ends = [0]
        for unit in re.findall(r"[^\n]*\n|[^\n]+", text):
            ends.append(ends[-1] + len(unit))
        assert infill.unit_ends(text).tolist() == ends
    assert infill.unit_ends("").tolist() == [0]
