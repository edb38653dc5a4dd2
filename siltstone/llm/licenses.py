"""Licence scans: text compared with licence templates by Dice coefficient over word bigrams.

Compared are a text's lines, the text as a whole, and windows of it as long as a template, which
find notices and licence texts that are wrapped over lines or stand inside others. All is
normalised (lower case, letters and digits, dots inside numbers) and taken as distinct
word bigrams. For Dice d the smaller of two sets has at least d / (2 - d) of the larger's
members, so numbers of words alone rule out most templates before any bigram is made. A
window is opened where one of a template's ``ANCHORS`` rarest bigrams stands, at its place in the template.
"""

from __future__ import annotations

import json
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Notices by which texts name a licence, with its SPDX name.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Use of this source code is governed by a BSD 2-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    # headers and bodies
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
]

DICE = 0.9
ANCHORS = 3  # bigrams of a template whose occurrences open windows


def normalised(text: Column) -> Column:
    """Lower case, runs of letters and digits, dots between digits and line breaks kept, the rest as single spaces."""
    return F.regexp_replace(F.lower(F.regexp_replace(text, r"(?<=\d)\.(?=\d)", "·")), r"[^\p{L}\p{N}·\n]+", " ")


def bigrams(words: Column) -> Column:
    """Distinct pairs of neighbouring words; a single word stands for itself."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)))
    return F.when(F.size(words) > 1, F.array_distinct(pairs)).otherwise(words)


def _template_words(text: str) -> list[str]:
    out, word = [], ""
    for i, c in enumerate(text.lower() + " "):
        inner = c == "." and text[i - 1 : i].isdigit() and text[i + 1 : i + 2].isdigit()
        if c.isalnum() or inner:
            word += "·" if inner else c
        elif word:
            out, word = [*out, word], ""
    return out


def template_pairs(templates: list[tuple[str, str]]) -> list[tuple[str, list[str]]]:
    """Licence and sorted distinct bigrams of each template."""
    out = []
    for name, text in templates:
        words = _template_words(text)
        out.append((name, sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}) or words))
    return out


def anchors(templates: list[tuple[str, str]]) -> list[tuple[int, str, str, int, int]]:
    """(template, word, word, place, words): the bigrams of each template that are in the fewest templates, spread over it."""
    words = [_template_words(text) for _, text in templates]
    held = Counter(x for w in words for x in set(zip(w, w[1:], strict=False)))
    out = []
    for t, w in enumerate(words):
        found = list(enumerate(zip(w, w[1:], strict=False)))
        if not found:
            continue
        size = max(1, -(-len(found) // ANCHORS))  # the rarest of each part, of equally rare ones the longest
        for part in (found[i : i + size] for i in range(0, len(found), size)):
            at, (a, b) = min(part, key=lambda x: (held[x[1]], -len(x[1][0]) - len(x[1][1]), x[0]))
            out.append((t, a, b, at, len(w)))
    return out


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, dice: float = DICE) -> DataFrame:
    """doc_id, n_lines, licenses for each row of ``docs`` (doc_id, text).

    ``licenses``: array of (line, license, dice), in order of line and name: every
    line, numbered from 1, that reaches ``dice`` against a template of that licence, or in which a window begins that does,
    with its best value; line 0 stands for the whole text where it has several lines. Null
    and empty texts have no lines. Repeated rows and rows without doc_id return
    one each; an empty table gives an empty result; other columns are not read.

    No shuffle: templates are literals, so each row is scanned where it is read.
    """
    texts = templates or TEMPLATES
    known = template_pairs(texts)
    least = min(len(p) for _, p in known)
    most = max(len(p) for _, p in known)
    low, ratio = least * dice / (2 - dice), (2 - dice) / dice
    # a table is one literal, read once when the plan is made: thousands of them would take the optimizer longer than the scan
    constant = lambda rows, kind: F.from_json(F.lit(json.dumps(rows)), f"array<struct<{kind}>>")
    table = constant([{"license": n, "pairs": p} for n, p in known], "license:string,pairs:array<string>")

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    clean = normalised(text)
    lines = F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, "\n"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lines.alias("parts"))
    worded = F.transform("parts", lambda x, i: F.struct((i + 1).cast("int").alias("line"), F.filter(F.split(x, " "), lambda w: w != "").alias("words")))
    rows = rows.select("doc_id", F.size("parts").cast("long").alias("n_lines"), worded.alias("worded"))
    everything = F.struct(F.lit(0).alias("line"), F.flatten(F.transform("worded", lambda x: x["words"])).alias("words"))
    units = F.when(F.size("worded") > 1, F.concat(F.array(everything), "worded")).otherwise(F.col("worded"))
    # w words make w - 1 bigrams at most, and d distinct words d - 1 distinct bigrams at least
    sized = F.filter(units, lambda x: (F.greatest(F.size(x["words"]) - 1, F.lit(1)) >= low) & (F.size(x["words"]) > 0))
    sized = F.filter(sized, lambda x: (F.size(x["words"]) <= most * ratio) | (F.size(F.array_distinct(x["words"])) - 1 <= most * ratio))
    paired = F.transform(sized, lambda x: F.struct(x["line"].alias("line"), bigrams(x["words"]).alias("pairs")))
    bounded = F.filter(paired, lambda x: (F.size(x["pairs"]) <= most * ratio) & (F.size(x["pairs"]) >= low))

    def against(x: Column) -> Column:
        near = F.filter(table, lambda t: (F.size(t["pairs"]) * ratio >= F.size(x["pairs"])) & (F.size(x["pairs"]) * ratio >= F.size(t["pairs"])))
        scored = F.transform(
            near,
            lambda t: F.struct(
                x["line"].alias("line"),
                t["license"].alias("license"),
                (2.0 * F.size(F.array_intersect(x["pairs"], t["pairs"])) / (F.size(x["pairs"]) + F.size(t["pairs"]))).alias("dice"),
            ),
        )
        return F.filter(scored, lambda m: m["dice"] >= dice)

    # windows: where an anchor stands, as many words as its template has, the anchor at its place
    found = [{"bigram": f"{a} {b}", "first": a, "second": b, "place": at, "words": n, "license": known[t][0], "pairs": known[t][1]} for t, a, b, at, n in anchors(texts)]
    opening = constant(found, "bigram:string,first:string,second:string,place:int,words:int,license:string,pairs:array<string>")
    rare = F.array(*[F.lit(f"{a} {b}") for a, b in sorted({(a, b) for _, a, b, _, _ in anchors(texts)})])
    none = F.array().cast("array<struct<line:int,license:string,dice:double>>")
    # a lambda over one element gives a value a name: it is worked out once a row, not once an anchor
    named = lambda value, body: F.flatten(F.transform(F.array(value), body))

    def windows(o: Column, doc: Column) -> Column:
        words = doc["words"]
        starts = F.filter(F.sequence(F.lit(0), F.size(words) - 2), lambda i: (F.get(words, i) == o["first"]) & (F.get(words, i + 1) == o["second"]))

        def window(i: Column) -> Column:
            low, high = F.greatest(i - o["place"], F.lit(0)), F.least(i - o["place"] + o["words"], F.size(words))

            def scored(pairs: Column) -> Column:
                score = 2.0 * F.size(F.array_intersect(pairs, o["pairs"])) / (F.size(pairs) + F.size(o["pairs"]))
                return F.array(F.struct(F.get(doc["lines"], low).alias("line"), o["license"].alias("license"), score.alias("dice")))

            return named(bigrams(F.slice(words, low + 1, high - low)), scored)

        return F.filter(F.flatten(F.transform(starts, window)), lambda m: m["dice"] >= dice)

    def opened(doc: Column) -> Column:
        of = lambda met: F.flatten(F.transform(F.filter(opening, lambda o: F.array_contains(met, o["bigram"])), lambda o: windows(o, doc)))
        return named(F.array_intersect(rare, bigrams(doc["words"])), lambda met: F.when(F.size(met) > 0, of(met)).otherwise(none))

    words = F.flatten(F.transform("worded", lambda x: x["words"]))
    lines = F.flatten(F.transform("worded", lambda x: F.transform(x["words"], lambda w: x["line"])))
    inside = named(F.struct(words.alias("words"), lines.alias("lines")), lambda doc: F.when(F.size(doc["words"]) > 1, opened(doc)).otherwise(none))
    matched = F.array_sort(F.concat(F.flatten(F.transform(bounded, against)), F.coalesce(inside, none)))
    # sorted ascending: of one line and licence the last value is the best
    best = F.filter("matches", lambda m, i: (i + 1 >= F.size("matches")) | F.coalesce((F.get("matches", i + 1)["line"] != m["line"]) | (F.get("matches", i + 1)["license"] != m["license"]), F.lit(True)))
    scanned = rows.select("doc_id", "n_lines", matched.alias("matches"))
    return scanned.select("doc_id", "n_lines", best.alias("licenses"))
