"""Nested outputs: JSON trees as VARIANT, walked node by node, changed at their leaves and put together again.

Strings are listed and changed without a shuffle, a row a tree. A walk over all nodes takes one level of all trees a round: the children of the nodes that the round before
left open. So rows are nodes, not trees, a tree of any width spreads over tasks, and there are as many rounds
as the deepest tree has levels. Names in objects aren't text, only leaves are. Trees are built from their leaves
bottom-up, a level a round, each object or list from its own children.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.storage import cut

DEPTH = 64  # levels that a tree may have
_PATH = "array<struct<at:int,name:string>>"


def _kind(v: Column) -> Column:
    kind = F.schema_of_variant(v)
    return F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string").otherwise("other")


def quoted(text: Column) -> Column:
    """A text as a JSON string; null stays null."""
    whole = F.to_json(F.struct(text.alias("k")))
    return F.when(text.isNotNull(), F.substring(whole, F.lit(6), F.length(whole) - 6))


def nodes(rows: DataFrame, key: str, tree: str) -> DataFrame:
    """(key, path, kind, text, value): every node of the JSON texts in ``tree``, the root with an empty path.

    ``path`` is an array of (at, name): the place among siblings, and the name within an object, null within a list; members of an object are in the order
    of their names. ``kind``: object, array, string or other. ``text``: of a string. ``value``: the JSON of a leaf that is no string, null
    otherwise; numbers are written as VARIANT writes them. ``key`` tells rows apart. A null tree has no node. A text that is no JSON, or has a
    name twice in an object, stops the job, as does a tree of more than DEPTH levels.
    """
    spark = rows.sparkSession
    level = rows.where(F.col(tree).isNotNull()).select(key, F.array().cast(_PATH).alias("path"), F.parse_json(tree).alias("v"))
    out = None
    for _ in range(DEPTH):
        known = cut(level.withColumn("kind", _kind(F.col("v"))), "nodes")
        inner = F.col("kind").isin("object", "array")
        text = F.when(F.col("kind") == "string", F.variant_get("v", "$", "string"))
        found = known.select(key, "path", "kind", text.alias("text"), F.when(F.col("kind") == "other", F.to_json("v")).alias("value"))
        out = found if out is None else out.unionByName(found)
        children = known.where(inner).lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).select(F.col("pos"), F.col("key").alias("name"), F.col("value").alias("child")))
        level = children.select(key, F.concat("path", F.array(F.struct(F.col("pos").alias("at"), "name")).cast(_PATH)).alias("path"), F.col("child").alias("v"))
        if known.where(inner).isEmpty():
            return out
    raise ValueError(f"a tree has more than {DEPTH} levels")


def shown(path: Column) -> Column:
    """A path as text: .name within objects, [at] within lists."""
    return F.array_join(F.transform(path, lambda x: F.coalesce(F.concat(F.lit("."), x["name"]), F.concat(F.lit("["), x["at"].cast("string"), F.lit("]")))), "")


def _deepest(trees: DataFrame, tree: str) -> int:
    """How many levels of objects and lists the deepest of the JSON texts has: by brackets outside of strings, counted once for each sequence of them."""
    bare = F.regexp_replace(F.replace(F.replace(tree, F.lit("\\\\"), F.lit("")), F.lit('\\"'), F.lit("")), '"[^"]*"', "")
    shapes = trees.select(F.regexp_replace(bare, r"[^\[\]{}]+", "").alias("shape")).distinct()
    signs = F.transform(F.split("shape", ""), lambda c: F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0))
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    depth = F.aggregate(signs, zero, lambda s, x: F.struct((s["now"] + x).alias("now"), F.greatest(s["most"], s["now"] + x).alias("most")))["most"]
    return shapes.agg(F.max(depth)).first()[0] or 0


def strings(rows: DataFrame, key: str, tree: str) -> DataFrame:
    """(key, path, text): the string leaves of each tree, as :func:`nodes` has them.

    Only the trees are written, once, to know the deepest; then each level is opened in the same pass and no node is written.
    """
    spark = rows.sparkSession
    own = cut(rows.where(F.col(tree).isNotNull()).select(key, F.col(tree).alias("tree")), "trees")
    deepest = _deepest(own, "tree")
    if deepest >= DEPTH:
        raise ValueError(f"a tree has more than {DEPTH} levels")
    level = own.select(key, F.array().cast(_PATH).alias("path"), F.parse_json("tree").alias("v"))
    for _ in range(deepest):
        children = level.lateralJoin(spark.tvf.variant_explode_outer(F.col("v").outer()).select(F.col("pos"), F.col("key").alias("name"), F.col("value").alias("child")))
        there = F.col("pos").isNotNull()
        path = F.when(there, F.concat("path", F.array(F.struct(F.col("pos").alias("at"), "name")).cast(_PATH))).otherwise(F.col("path"))
        level = children.select(key, path.alias("path"), F.when(there, F.col("child")).otherwise(F.col("v")).alias("v"))
    return level.where(F.schema_of_variant("v") == "STRING").select(key, "path", F.variant_get("v", "$", "string").alias("text"))


def rebuilt(found: DataFrame, key: str) -> DataFrame:
    """(key, tree): trees from the nodes that :func:`nodes` gives, their texts and values maybe changed."""
    empty = F.when(F.col("kind") == "object", "{}").when(F.col("kind") == "array", "[]")
    found = cut(found.select(key, "path", "kind", F.coalesce(F.when(F.col("kind") == "string", quoted(F.col("text"))), "value").alias("json"), F.size("path").alias("depth")), "leaves")
    deepest = found.agg(F.max("depth")).first()[0]
    done = None
    for depth in range(deepest or 0, -1, -1):
        own = found.where(F.col("depth") == depth)
        if done is None:
            done = own.select(key, "path", F.coalesce("json", empty).alias("json"))
            continue
        step = F.element_at("path", -1)
        part = F.concat(F.coalesce(F.concat(quoted(step["name"]), F.lit(":")), F.lit("")), F.col("json"))
        up = done.select(key, F.slice("path", 1, depth).alias("path"), F.struct(step["at"].alias("at"), part.alias("part")).alias("p"))
        joined = up.groupBy(key, "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["part"]), ",").alias("inner"))
        both = own.join(joined, [key, "path"], "left")
        filled = F.when(F.col("kind") == "object", F.concat(F.lit("{"), "inner", F.lit("}"))).otherwise(F.concat(F.lit("["), "inner", F.lit("]")))
        done = cut(both.select(key, "path", F.coalesce("json", filled, empty).alias("json")), "built")
    if done is None:
        return found.select(key, F.lit(None).cast("string").alias("tree"))
    return done.select(key, F.col("json").alias("tree"))


_SLASH, _QUOTE = "\x01", "\x02"  # escaped backslashes and quotes for the while: JSON as VARIANT writes it has no control characters
_BETWEEN = set('[]{}:,"0123456789+-.eEtruefalsenull')  # what such a text has outside of its strings


def _marked(tree: Column) -> Column:
    return F.replace(F.replace(F.to_json(F.parse_json(tree)), F.lit("\\\\"), F.lit(_SLASH)), F.lit('\\"'), F.lit(_QUOTE))


def _real(marked: Column) -> Column:
    return F.replace(F.replace(marked, F.lit(_SLASH), F.lit("\\\\")), F.lit(_QUOTE), F.lit('\\"'))


def _changed(marked: Column, change: Callable[[Column], Column]) -> Column:
    """The JSON text of ``marked`` with ``change`` applied to its string leaves.

    Its quotes cut it into pieces, every other one a string, and a string is a name if a colon follows.
    """

    def read(x: Column) -> Column:
        plain = ~x.rlike(r"[\\\x01\x02]")
        return F.when(plain, x).otherwise(F.variant_get(F.parse_json(F.concat(F.lit('"'), _real(x), F.lit('"'))), "$", "string"))

    def told(pieces: Column) -> Column:
        leaf = lambda i: (i % 2 == 1) & ~F.get(pieces, i + 1).startswith(":")
        return F.transform(pieces, lambda x, i: F.when(leaf(i), F.struct(F.lit("leaf").alias("kind"), change(read(x)).alias("x"))).otherwise(F.struct(F.when(i % 2 == 1, "name").otherwise("between").alias("kind"), x.alias("x"))))

    def written(p: Column) -> Column:
        simple = ~p["x"].rlike(r'[\x00-\x1f"\\]')
        leaf = F.when(p["x"].isNull(), "null").when(simple, F.concat(F.lit('"'), p["x"], F.lit('"'))).otherwise(quoted(p["x"]))
        return F.when(p["kind"] == "between", p["x"]).when(p["kind"] == "name", F.concat(F.lit('"'), _real(p["x"]), F.lit('"'))).otherwise(leaf)

    # as the one item of an array the pieces are a variable in the function
    pieces = F.get(F.transform(F.array(F.split(marked, '"')), told), F.lit(0))
    return F.array_join(F.transform(pieces, written), "")


def mapped(rows: DataFrame, key: str, tree: str, change: Callable[[Column], Column]) -> DataFrame:
    """(key, tree): each tree with ``change``, made of Spark's functions, applied to its string leaves, in the same shape.

    Null trees stay null, a leaf that becomes null is a null of JSON. A tree is changed where it stands: nothing is shuffled or written.
    """
    return rows.select(key, _marked(F.col(tree)).alias("tree")).select(key, _changed(F.col("tree"), change).alias("tree"))


def without(rows: DataFrame, key: str, tree: str, fragments: list[str]) -> DataFrame:
    """(key, tree): each tree with ``fragments`` taken out of its string leaves, one after another; empty fragments are none.

    A fragment that can only stand in a string goes by a pattern: where the next quote ends a leaf, no colon behind it. Texts with other
    escapes than of backslashes and quotes, in which a fragment could meet half an escape, and other fragments go by :func:`mapped`'s way.
    """
    fragments = [x for x in fragments if x]

    def change(text: Column) -> Column:
        for fragment in fragments:
            text = F.replace(text, F.lit(fragment), F.lit(""))
        return text

    marked = F.col("tree")
    own = rows.select(key, _marked(F.col(tree)).alias("tree"))
    if not all(set(x) - _BETWEEN - {"\\"} and min(x) >= " " for x in fragments):
        return own.select(key, _changed(marked, change).alias("tree"))
    quick = marked
    for fragment in fragments:
        literal = "".join("\\x{%x}" % ord(c) for c in fragment.replace("\\", _SLASH).replace('"', _QUOTE))
        quick = F.regexp_replace(quick, literal + r'(?=[^"]*+"(?!:))', "")
    return own.select(key, F.when(marked.contains("\\"), _changed(marked, change)).otherwise(_real(quick)).alias("tree"))


def emptied(tree: Column) -> Column:
    """The empty output of a tree's own kind: an object for an object, else a text."""
    return F.when(F.ltrim(tree).startswith("{"), "{}").otherwise('""')
