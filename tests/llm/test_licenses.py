import re

from siltstone.llm import licenses


def words(text):
    text = re.sub(r"(?<=\d)\.(?=\d)", "·", text or "")
    return re.findall(r"(?:[^\W_]|·)+", text.lower())


def pairs(w):
    return {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)} or set(w)


def brute(text):
    lines = text.split("\n") if text else []
    units = list(enumerate(lines, 1)) + ([(0, text)] if len(lines) > 1 else [])
    best = {}
    for line, t in units:
        mine = pairs(words(t))
        for name, template in licenses.TEMPLATES:
            theirs = pairs(words(template))
            d = 2 * len(mine & theirs) / (len(mine) + len(theirs)) if mine else 0
            if d >= licenses.DICE:
                best[line, name] = max(d, best.get((line, name), 0))
    spelt = [(w, i) for i, line in enumerate(lines, 1) for w in words(line)]
    for n, a, b, at, size in licenses.anchors(licenses.TEMPLATES):
        name, template = licenses.TEMPLATES[n]
        theirs = pairs(words(template))
        for i in range(len(spelt) - 1):
            if (spelt[i][0], spelt[i + 1][0]) == (a, b):
                window = spelt[max(0, i - at) : i - at + size]
                mine = pairs([w for w, _ in window])
                d = 2 * len(mine & theirs) / (len(mine) + len(theirs))
                if d >= licenses.DICE:
                    best[window[0][1], name] = max(d, best.get((window[0][1], name), 0))
    return len(lines), sorted((a, b, d) for (a, b), d in best.items())


def test_scan_matches_brute_force(spark):
    texts = [None, "", "no licence here", "Some text.\nReleased under the MIT License.", "released under  the MIT license", "x\nLicensed under CC BY-NC 4.0.\ny\nLicensed under CC BY 4.0.\n\n"]
    texts += [t for _, t in licenses.TEMPLATES] + ["This work is licensed under the\nGNU General Public License, version 3.", "word " * 30000, ("Released under the MIT License.\n" * 40)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, "Released under the MIT License.")], "doc_id long, text string").selectExpr("*", "1 as parts", "2 as line")
    out = licenses.license_scan(df).collect()
    assert len(out) == len(texts) + 1
    for r in out:
        n, want = brute("Released under the MIT License." if r.doc_id is None else texts[r.doc_id])
        assert r.n_lines == n
        assert [(m.line, m.license, m.dice) for m in r.licenses] == want


def test_wrapped_and_embedded_notices_are_found(spark):
    mit = dict(licenses.TEMPLATES[::-1])["MIT"]
    body = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 300).split()
    wrapped = "\n * ".join(" ".join(body[i : i + 9]) for i in range(0, len(body), 9))
    gpl = next(t for n, t in licenses.TEMPLATES if n == "GPL-3.0" and "redistribute" in t)
    texts = [f"/*\n * Copyright 2020\n * {wrapped}\n */\nint main;", "This project and its docs are released under the MIT License.", f"text before. {gpl.replace('Foundation', 'foundation of all')} and after", "word " * 400 + "\nLicensed under\nCC BY-SA 4.0 or so"]
    out = license_names(spark, texts)
    assert out[0] == ["MIT"] and out[1] == ["MIT"] and out[2] == ["GPL-3.0"] and out[3] == [] and mit


def license_names(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: sorted({m.license for m in r.licenses}) for r in licenses.license_scan(df).collect()}


def test_empty_table(spark):
    assert licenses.license_scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
