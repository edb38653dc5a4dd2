"""Text normalisation, splitting, tokens and text rules as column expressions.

Everything is a built-in expression but two Arrow UDFs, NFKC and case folding, which
Spark has no function for. Each text is meant to pass them once, at ingest.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What counts as no value, the dots that names are decorated with, separators, and Unicode's spaces.
EMPTY_VALUES = ["unknown", "未知", "暂无", "无", "null", "none", "n/a", "-", "--"]
NAME_DOTS = "·•∙・･‧"
MULTI_SEPARATORS = "[；;、\\n]+"
EDGE_SIGNS = " -—–:：;；、,.，。·•"
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
CJK = "\\u3400-\\u4dbf\\u4e00-\\u9fff"


@F.arrow_udf(StringType())
def _nfkc(text: pa.Array) -> pa.Array:
    return pa.array((None if (t := x.as_py()) is None else unicodedata.normalize("NFKC", t) for x in text), pa.string())


def nfkc(text: Column) -> Column:
    """NFKC. ASCII is its own: only other texts go to Python."""
    ascii_ = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_, text).otherwise(_nfkc(F.when(~ascii_, text)))


@F.pandas_udf(StringType())
def casefold(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else x.casefold())


def fold_text(text: str) -> str:
    """NFKC, then case folded."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).casefold()


@F.pandas_udf(StringType())
def _folded(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else fold_text(x))


def folded(text: Column) -> Column:
    """NFKC, then case folded. ASCII needs neither: it is lower-cased in the JVM, and only other texts go to Python."""
    ascii_ = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_, F.lower(text)).otherwise(_folded(F.when(~ascii_, text)))


def collapsed(text: Column) -> Column:
    """Runs of Unicode white space as one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def plain_spaced(text: Column) -> Column:
    """Runs of ASCII white space as one space, ends without spaces of any width; all other signs stay, as do texts that say nothing."""
    return F.btrim(F.regexp_replace(text, r"[ \t\n\f\r]+", " "), F.lit(SPACES))


def latin(text: Column) -> Column:
    """en for a text with a Latin letter, else unknown."""
    return F.when(text.rlike("[A-Za-z]"), "en").otherwise("unknown")


def meaningful(text: Column) -> Column:
    """Collapsed text; null if nothing, only punctuation, or a word for "no value"."""
    clean = collapsed(text)
    none = (clean == "") | clean.rlike(r"(?U)^[\W_]+$") | F.lower(clean).isin(EMPTY_VALUES)
    return F.when(~none, clean)


def normalize_text(text: Column) -> Column:
    return meaningful(nfkc(text))


def name_key(text: Column) -> Column:
    """Identity key of a name: normalised, decorative dots deleted, case folded."""
    key = casefold(F.translate(normalize_text(text), NAME_DOTS, ""))
    return F.when(key != "", key)


def email(text: Column) -> Column:
    """An address with its domain in lower case; null if it isn't one."""
    clean = normalize_text(text)
    return F.when(clean.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), F.concat(F.substring_index(clean, "@", 1), F.lit("@"), F.lower(F.substring_index(clean, "@", -1))))


def fold(text: Column) -> Column:
    """Case folding without Python, for use inside array functions: upper case first, which spells out what has two cases of unequal length."""
    return F.lower(F.upper(text))


def first_of_each(items: Column, key) -> Column:
    """Array without the items whose key came before: sorted by key and place, so that repeats stand behind their first, and back."""
    at = F.transform(items, lambda x, i: F.struct(key(x).alias("key"), i.alias("at"), x.alias("value")))
    placed = F.array_sort(F.filter(at, lambda x: x["key"].isNotNull()))
    # as the one item of an array the sorted items are a variable below; elsewhere they would be worked out again for each item
    first = F.transform(F.array(placed), lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["key"] != x["key"])))
    kept = F.array_sort(F.transform(F.get(first, F.lit(0)), lambda x: F.struct(x["at"].alias("at"), x["value"].alias("value"))))
    return F.transform(kept, lambda x: x["value"])


def multivalue(normal: Column) -> Column:
    """Values of a field that lists several, without repeats in another case.

    ``normal`` is a column of NFKC text: the UDF can't stand inside the array functions. It is collapsed first, so line breaks are spaces by then and don't split.
    """
    parts = F.filter(F.transform(F.split(meaningful(normal), MULTI_SEPARATORS), meaningful), lambda x: x.isNotNull())
    return F.coalesce(first_of_each(parts, fold), F.array().cast("array<string>"))


def language(text: Column) -> Column:
    """Script of a text: zh, en, mixed or unknown."""
    han, latin = text.rlike(f"[{CJK}]"), text.rlike("[A-Za-z]")
    return F.when(han & latin, "mixed").when(han, "zh").when(latin, "en").otherwise("unknown")


def statements(text: Column) -> Column:
    """Research statements of a raw field: array of (raw, text, language, hash).

    Splits on separators and line breaks, drops a field label, a list marker and edge signs.
    """
    raw = F.filter(F.transform(F.split(text, MULTI_SEPARATORS), lambda x: F.trim(x)), lambda x: x != "")
    label = r"^(?:研究方向|研究领域|研究兴趣|Research (?:interests?|areas?|directions?))\s*[:：]\s*"
    marker = r"^\s*(?:[\(（\[【]?\d{1,3}[\)）\]】.、:：]|[-*•·])\s*"

    def clean(x: Column) -> Column:
        return F.btrim(F.regexp_replace(F.regexp_replace(collapsed(x), f"(?i){label}", ""), marker, ""), F.lit(EDGE_SIGNS))

    parts = F.filter(F.transform(raw, lambda x: F.struct(x.alias("raw"), clean(x).alias("text"))), lambda x: x["text"].rlike(r"(?U)[\p{L}\p{N}]"))
    kept = first_of_each(parts, lambda x: fold(x["text"]))
    return F.transform(kept, lambda x: F.struct(x["raw"].alias("raw"), x["text"].alias("text"), language(x["text"]).alias("language"), F.sha2(x["text"].cast("binary"), 256).alias("hash")))


def dois(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"(?i)\b(10\.\d{4,9}/[^\s\"<>]+)"), 1)
    return F.array_distinct(F.transform(found, lambda x: F.lower(F.regexp_replace(x, "[.,;:，。；：\\])}）]+$", ""))))


def years(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<!\d)((?:19|20)\d{2})(?!\d)"), 1))


def publications(text: Column) -> Column:
    """Publication mentions: array of (text, doi, year, needs_review); only full-width ； and line breaks split."""
    parts = F.filter(F.transform(F.split(text, "[；\\n]+"), collapsed), lambda x: x.rlike(r"(?U)[\p{L}\p{N}]"))

    def mention(x: Column) -> Column:
        d, y = dois(x), years(x)
        one = lambda a: F.when(F.size(a) == 1, a[0])
        return F.struct(x.alias("text"), one(d).alias("doi"), one(y).cast("int").alias("year"), ((F.size(d) > 1) | (F.size(y) > 1)).alias("needs_review"))

    return F.transform(first_of_each(parts, fold), mention)


def bm25_tokens(folded: Column) -> Column:
    """Tokens of case-folded text: ASCII words, and for Han runs each sign and each pair of signs."""
    runs = F.regexp_extract_all(folded, F.lit(f"[A-Za-z0-9_]+|[{CJK}]+"), 0)

    def of(run: Column) -> Column:
        pairs = F.transform(F.filter(F.sequence(F.lit(1), F.length(run)), lambda i: i < F.length(run)), lambda i: F.substr(run, i, F.lit(2)))
        return F.when(run.rlike(f"^[{CJK}]"), F.concat(F.split(run, ""), pairs)).otherwise(F.array(run))

    return F.flatten(F.transform(runs, of))


def sparse_tokens(folded: Column) -> Column:
    """Longest runs of Han signs or ASCII word signs, without pairs."""
    return F.regexp_extract_all(folded, F.lit(f"[{CJK}]+|[A-Za-z0-9_]+"), 0)


def normal_lines(text: Column) -> Column:
    """Lines collapsed, empty ones dropped."""
    lines = F.transform(F.split(text, "\\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\x0B\f\r]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


#: Contact details that generated text mustn't carry.
CONTACTS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "mobile": r"\b1[3-9][0-9]{9}\b",
    "phone": r"\+?[0-9]{1,3}[ -]\(?[0-9]{2,4}\)?[ -][0-9]{3,4}[ -]?[0-9]{3,4}",
}


def redacted(text: Column, mark: str = "[contact]") -> Column:
    for pattern in CONTACTS.values():
        text = F.regexp_replace(text, pattern, mark)
    return text


def contact_kinds(text: Column) -> Column:
    """Names of the contact details in a text, in fixed order, joined by commas."""
    return F.concat_ws(",", *[F.when(text.rlike(p), F.lit(k)) for k, p in CONTACTS.items()])
