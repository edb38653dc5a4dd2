"""Records that a model extracted, made regular: texts, lists of values, addresses; nothing is made up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields of a record by kind.
TEXTS = ("title", "phone", "bio", "enrollment_pref")
LISTS = ("research_areas", "publications")
EMAILS = ("email",)
ADDRESSES = ("homepage", "external_link")

_EMAIL = r"(?U)^[^@\s]+@[^@\s]+\.[^@\s]+$"


def _squeezed(x: Column) -> Column:
    """White space as single spaces, none at the ends; null if nothing is left."""
    clean = F.regexp_replace(F.regexp_replace(x, r"(?U)\s+", " "), "^ | $", "")
    return F.when(clean != "", clean)


def _items(v: Column, name: str) -> Column:
    """The items of a field that is a list, as texts; null for other fields."""
    return F.transform(F.try_variant_get(v, f"$.{name}", "array<variant>"), lambda x: F.coalesce(F.try_variant_get(x, "$", "string"), F.lit("None")))


def _one(v: Column, name: str) -> Column:
    """A field as one text, the items of a list with spaces between."""
    return _squeezed(F.coalesce(F.array_join(_items(v, name), " "), F.try_variant_get(v, f"$.{name}", "string")))


def _many(v: Column, name: str) -> Column:
    """The distinct values of a field that is a list or a text with separators, joined again."""
    given = F.coalesce(_items(v, name), F.split(F.try_variant_get(v, f"$.{name}", "string"), "[;；,，、\\n]"))
    kept = F.array_distinct(F.filter(F.transform(given, _squeezed), lambda x: x.isNotNull()))
    return F.when(F.size(kept) > 0, F.array_join(kept, "；"))


def sanitized(rows: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, name and the fields above) of the JSON objects in ``raw``; records without a name, and null ones, go.

    A field may be a text, a number, a list or null. Mail addresses and links that aren't some become null. Items of a list that are null
    count as the word None in a text, as they are in what models write. A text that is no JSON stops the job.
    """
    v = F.col("_v")
    own = rows.select(key, F.parse_json(raw).alias("_v"))
    one, many = ("name", *TEXTS, *EMAILS, *ADDRESSES), LISTS
    told = own.select(key, *(_one(v, c).alias(c) for c in one), *(_many(v, c).alias(c) for c in many))
    checked = lambda c, pattern: F.when(F.col(c).rlike(pattern), F.col(c)).alias(c)
    fields = [*("name", *TEXTS, *LISTS), *(checked(c, _EMAIL) for c in EMAILS), *(checked(c, "(?i)^https?://") for c in ADDRESSES)]
    return told.select(key, *fields).where("name IS NOT NULL")
