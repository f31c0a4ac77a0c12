"""Small expressions over section text: code groups, sentences, measures and meaningful values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheetwright.functions.codes import found
from sheetwright.functions.text import bound, collapsed, unique_ci, where_held


def joined_hazard_codes(text: Column) -> Column:
    """``H 315`` becomes ``H315``."""
    return F.regexp_replace(text, r"H(?<=\bH)\s+(\d{3})\b", "H$1")


def joined_p_groups(text: Column) -> Column:
    """``P305 + 351`` becomes ``P305+P351``, for groups of any length: each number joins where the one before it ended."""
    return where_held(text, ["+"], lambda v: F.regexp_replace(v, r"(?:(P\d{3})|\G(?<=\d))\s*\+\s*P?(\d{3})(?!\d)", "$1+P$2"))


def sentences(text: Column) -> Column:
    """Sentences: after ``.``, ``!`` or ``?`` before a capital; distinct."""
    return unique_ci(F.split(F.coalesce(collapsed(text), F.lit("")), r"(?<=[.!?])\s+(?=[A-ZÇĞİÖŞÜ])"))


def thicknesses(text: Column) -> Column:
    """Measures in millimetres, with a comparison before them, distinct, without blanks around the sign."""
    return F.array_distinct(F.transform(found(text, r"(?i)(?:>=|<=|[≥≤<>])?\s*\d+(?:[.,]\d+)?\s*mm\b"), lambda x: F.trim(x)))


def is_meaningful(text: Column) -> Column:
    """At least twelve characters and three words."""
    tidy = F.coalesce(collapsed(text), F.lit(""))
    return (F.length(tidy) >= 12) & (F.size(F.split(tidy, " ")) >= 3)


def subsections(section: Column, number: int) -> Column:
    """Map from 1 to 9 of the texts that follow ``number.n`` at a line's start, ascending numbers only."""
    heads = found(section, rf"(?m)^[ \t]*{number}\.([1-9])(?![.\d])", 1)
    texts = F.slice(F.split(F.coalesce(section, F.lit("")), rf"(?m)^[ \t]*{number}\.[1-9](?![.\d])", -1), F.lit(2), F.size(heads))
    pairs = F.zip_with(heads, texts, lambda n, t: F.struct(n.cast("int").alias("key"), F.trim(F.regexp_replace(t, r"(?U)^\s+|\s+$", "")).alias("value")))
    return F.map_from_entries(bound(pairs, lambda all_: F.filter(all_, lambda p, i: ~F.exists(F.slice(all_, F.lit(1), i), lambda q: q["key"] >= p["key"]))))


def file_size(size: Column) -> Column:
    """Megabytes with two decimals, or kilobytes with one; nothing is ``0 KB``."""
    mb, kb = size / (1024 * 1024), size / 1024
    return F.when(F.coalesce(size, F.lit(0)) == 0, "0 KB").when(mb >= 1, F.concat(F.format_string("%.2f", mb), F.lit(" MB"))).otherwise(F.concat(F.format_string("%.1f", kb), F.lit(" KB")))
