import json
import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import nested


def leaves(x, path=""):
    if isinstance(x, dict):
        return [y for k, v in x.items() for y in leaves(v, f"{path}.{k}")]
    if isinstance(x, list):
        return [y for i, v in enumerate(x) for y in leaves(v, f"{path}[{i}]")]
    return [(path, x)] if isinstance(x, str) else []


def change(x, f):
    if isinstance(x, dict):
        return {k: change(v, f) for k, v in x.items()}
    if isinstance(x, list):
        return [change(v, f) for v in x]
    return f(x) if isinstance(x, str) else x


def drawn(draw, depth):
    kind = draw.randrange(8 if depth else 5)
    if kind < 2:
        return draw.choice(["", "text", 'say "hi"\\ \n\t', "é漢😀", "secret inside", "a secret secret", "\u0001"])
    if kind < 5:
        return draw.choice([None, True, False, 0, -7, 12345678901, 0.5])
    if kind < 7:
        return {draw.choice(["a", "b", "ключ", 'q"uote', "x.y", "", "secret"]) + str(i): drawn(draw, depth - 1) for i in range(draw.randrange(4))}
    return [drawn(draw, depth - 1) for _ in range(draw.randrange(5))]


@pytest.fixture(scope="module")
def trees():
    draw = random.Random(5)
    return [(i, drawn(draw, 5)) for i in range(150)] + [(1000, {}), (1001, []), (1002, ""), (1003, [[], {}, [[]]]), (1004, {"deep": [[[[{"x": ["leaf"]}]]]]})]


def table(spark, trees):
    return spark.createDataFrame([(i, json.dumps(t, ensure_ascii=bool(i % 2))) for i, t in trees] + [(999, None)], "id long, tree string").selectExpr("*", "'p' AS path", "1 AS kind")


def test_strings_with_their_paths(spark, trees):
    found = nested.strings(table(spark, trees), "id", "tree")
    got = sorted((r.id, r.path, r.text) for r in found.select("id", nested.shown(found.path).alias("path"), "text").collect())
    assert got == sorted((i, p, t) for i, x in trees for p, t in leaves(x)) and len(got) > 40


def test_maps_keep_the_shape(spark, trees):
    rows = table(spark, trees)
    for made, f in ((nested.without(rows, "id", "tree", ["secret", "", " "]), lambda s: s.replace("secret", "").replace(" ", "")), (nested.without(rows, "id", "tree", []), lambda s: s)):
        got = {r.id: r.tree for r in made.collect()}
        assert got.pop(999) is None and {i: json.loads(t) for i, t in got.items()} == {i: change(x, f) for i, x in trees}


def test_wide_trees_empty_tables_and_broken_texts(spark):
    wide = {"rows": [{"n": i, "t": f"text {i}"} for i in range(20_000)]}
    rows = spark.createDataFrame([(1, json.dumps(wide))], "id long, tree string")
    assert json.loads(nested.without(rows, "id", "tree", ["text "]).first().tree) == change(wide, lambda s: s.replace("text ", ""))
    assert nested.without(rows.limit(0), "id", "tree", ["x"]).collect() == [] and nested.strings(rows.limit(0), "id", "tree").collect() == []
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        nested.strings(spark.createDataFrame([(1, "{")], "id long, tree string"), "id", "tree").collect()


def test_empty_output_of_the_same_kind(spark):
    df = spark.createDataFrame([(' {"a": 1}',), ('"text"',), ("[1]",)], "t string")
    assert [r[0] for r in df.select(nested.emptied(df.t)).collect()] == ["{}", '""', '""']


def test_nodes_and_trees_rebuilt_from_them(spark, trees):
    got = {r.id: json.loads(r.tree) for r in nested.rebuilt(nested.nodes(table(spark, trees), "id", "tree"), "id").collect()}
    assert got == dict(trees)


def test_strings_are_changed_without_shuffles_and_files(spark, trees, monkeypatch):
    """No row a node is written or moved; leaves that become null, and what looks like names and brackets in strings."""
    monkeypatch.setattr(nested, "cut", lambda df, name: df if name == "trees" else pytest.fail(name))
    odd = [(1, {'a":': 'b":', "c\\": ["\\", '\\"', ":", '":"', "[{", "\x02"]}), (2, [["x"], "}]", {"": ":"}])]
    rows = table(spark, odd)
    made = nested.mapped(rows, "id", "tree", lambda x: F.when(x != ":", F.upper(x)))
    assert {r.id: json.loads(r.tree) for r in made.collect() if r.tree} == {i: change(x, lambda s: s.upper() if s != ":" else None) for i, x in odd}
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    found = nested.strings(rows, "id", "tree")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.id, r.path, r.text) for r in found.select("id", nested.shown(found.path).alias("path"), "text").collect()) == sorted((i, p, t) for i, x in odd for p, t in leaves(x))


@pytest.mark.parametrize("levels, fits", [(63, True), (64, False)])
def test_levels_that_a_tree_may_have(spark, levels, fits):
    rows = spark.createDataFrame([(1, "[" * levels + '"]["' + "]" * levels)], "id long, tree string")
    if fits:
        assert nested._deepest(rows, "tree") == levels
    else:
        with pytest.raises(ValueError, match="levels"):
            nested.strings(rows, "id", "tree")


@pytest.mark.parametrize("fragments", [["x", "F"], ["e", "x"], ['"', "F"], ["\\", 'x"'], ["n"], ["{x", " "], [":x"], ["\n", "F"], ["漢", "😀x", "."]])
def test_fragments_stay_in_names_and_escapes(spark, fragments):
    odd = [(i, {"F x": [s, None, True, 1.5], 'x"': {"\\e\n": s + "n"}, ":x": [[s, s]]}) for i, s in enumerate(["F", "x", 'xx"F', "\\n\\F", "a\nF", ":x", "{x} x", '":x', "漢.😀x", "", "true", "e\u0001e"])]
    got = {r.id: json.loads(r.tree) for r in nested.without(table(spark, odd), "id", "tree", fragments).collect() if r.tree}

    def cut(s):
        for f in fragments:
            s = s.replace(f, "")
        return s

    assert got == {i: change(x, cut) for i, x in odd}
