"""String functions of the engine: id lists, identifiers, hash buckets and number formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def id_list(text: Column) -> Column:
    """'1 2 3', '1,2,3', '"1 2"' or '[1, 2, 3]' as an array of longs; nothing for null or blank."""
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\[\]\"',\s]+", " "), " ")
    return F.transform(F.filter(parts, lambda p: p != ""), lambda p: p.cast("long"))


def identifier(name: Column) -> Column:
    """A table name: the stem in lower case, other characters as underscores, not starting with a digit."""
    stem = F.regexp_replace(F.regexp_extract(name, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    plain = F.regexp_replace(F.regexp_replace(F.lower(stem), r"[^a-z0-9_]+", "_"), r"^_+|_+$", "")
    return F.when(plain.rlike(r"^[0-9]"), F.concat(F.lit("layout_"), plain)).otherwise(plain)


def md5_bucket(text: Column, k: int) -> Column:
    """The 128-bit MD5 of the text modulo k, digit by digit: it does not fit a long."""
    digits = F.split(F.md5(text.cast("binary")), "")
    hexes = F.filter(digits, lambda d: d != "")
    return F.aggregate(hexes, F.lit(0).cast("long"), lambda acc, d: (acc * 16 + F.conv(d, 16, 10).cast("long")) % k)


def short_number(x: Column) -> Column:
    """Six decimals without trailing zeros."""
    fixed = F.format_string("%.6f", x.cast("double"))
    return F.regexp_replace(F.regexp_replace(fixed, r"0+$", ""), r"\.$", "")
