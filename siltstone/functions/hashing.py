"""Stable ids and digests as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_parts(*parts: Column) -> Column:
    """SHA-256 of the parts joined by NUL; null counts as the word None."""
    return F.sha2(F.concat_ws("\0", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts]).cast("binary"), 256)


def ordered_digest(key: Column, digest: Column) -> Column:
    """Aggregate: SHA-256 over the digests in the order of their keys, each with a line break behind it."""
    rows = F.array_sort(F.collect_list(F.struct(key.alias("k"), digest.alias("d"))))
    return F.sha2(F.concat(F.array_join(F.transform(rows, lambda x: x["d"]), "\n"), F.lit("\n")).cast("binary"), 256)


def sparse_index(version: str, token: Column) -> Column:
    """31 bits of the token's SHA-256 under a tokenizer version."""
    digest = F.sha2(F.concat(F.lit(version + "\0"), token).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(0x7FFFFFFF))


def uuid5(namespace: str, name: Column) -> Column:
    """Name-based UUID of version 5; ``namespace`` is a UUID in hex without dashes."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3))) + 8))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
