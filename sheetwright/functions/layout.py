"""Labels and values in lines: matching labels, values beside or below them, columns of labels, and blocks of lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheetwright.functions.structure import quoted
from sheetwright.functions.text import bound, clean_line, clean_lines, collapsed, filled, is_placeholder, sifted, unique_ci

_NUMBERING = r"^\d+(?:\.\d+)*\.?\s*"


def _tidy(line: Column) -> Column:
    """A line without bullets, surplus blanks and numbering."""
    return F.regexp_replace(clean_line(F.coalesce(line, F.lit(""))), _NUMBERING, "")


def label_key(label: Column) -> Column:
    """A label for comparison: no bullet, number or colon, lower case."""
    return F.lower(F.trim(F.regexp_replace(_tidy(label), r"\s*:\s*$", "")))


def is_label(text: Column, aliases: list[str]) -> Column:
    """The whole text is one of the labels."""
    return label_key(text).isin([a.strip().lower() for a in aliases])


def _said(value: Column) -> Column:
    """A collapsed value that is no placeholder, or null."""
    return bound(collapsed(value), lambda v: F.when(~is_placeholder(v), v))


def _leading(tidy: Column, aliases: list[str]) -> Column:
    return filled(F.lower(F.regexp_extract(tidy, rf"(?iu)^({sifted(aliases)}{quoted(aliases)})(?:\s*:|\s|$)", 1)))


def _beside(tidy: Column, aliases: list[str]) -> Column:
    return _said(F.regexp_extract(tidy, rf"(?iu)^{sifted(aliases)}{quoted(aliases)}(?:\s*:\s*|\s+)(.+)$", 1))


def leading_label(line: Column, aliases: list[str]) -> Column:
    """The longest label that a line begins with and that a colon, a blank or the line's end follows; else null."""
    return _leading(_tidy(line), aliases)


def value_beside(line: Column, aliases: list[str]) -> Column:
    """The value after a leading label and a colon or blanks; null where it says nothing."""
    return _beside(_tidy(line), aliases)


def value_below(lines: Column, i: Column, aliases: list[str]) -> Column:
    """The line after line ``i`` (from 0) if it says something and begins with no label."""
    return bound(collapsed(F.try_element_at(lines, i + 2)), lambda x: F.when(~is_placeholder(x) & leading_label(x, aliases).isNull(), x))


def field_value(lines: Column, aliases: list[str], every: list[str] | None = None) -> Column:
    """The value beside or below the first line with a label that has one; ``every``: labels that can't be values."""
    value = lambda all_: lambda x, i: F.when(leading_label(x, aliases).isNotNull(), F.coalesce(value_beside(x, aliases), value_below(all_, i, every or aliases)))
    each = bound(lines, lambda all_: F.transform(all_, value(all_)))
    return F.try_element_at(F.array_compact(each), F.lit(1))


def column_values(lines: Column, fields: dict[str, list[str]], least: int = 3) -> Column:
    """Map from field to value where at least ``least`` lines with bare labels stand above as many lines of values.

    Values end at a section's heading or another label; with fewer than two nothing is taken. A field's first value
    stays.
    """
    every = [a for names in fields.values() for a in names]

    # A bare label is a label with nothing beside it; which field's it is, a map of all labels tells.
    table = F.create_map(*[F.lit(x) for name, names in fields.items() for a in names for x in (a.lower(), name)])
    bare = lambda tidy, label: F.when(label.isNotNull() & _beside(tidy, every).isNull(), F.try_element_at(table, label))
    ends = lambda x, label: F.coalesce(label.isNotNull() | x.rlike(r"(?iu)^(?:BÖLÜM|SECTION)\s+\d+"), F.lit(False))
    kind = lambda x, tidy, label: F.struct(_said(x).alias("value"), bare(tidy, label).alias("field"), ends(x, label).alias("ends"))
    kinds = F.transform(lines, lambda x: bound(_tidy(x), lambda tidy: bound(_leading(tidy, every), lambda label: kind(x, tidy, label))))
    state = "struct<labels:array<string>,values:array<string>,open:boolean,out:array<struct<key:string,value:string>>>"
    none = F.array().cast("array<string>")
    empty = F.struct(none.alias("labels"), none.alias("values"), F.lit(True).alias("open"), F.array().cast("array<struct<key:string,value:string>>").alias("out")).cast(state)

    def closed(s: Column) -> Column:
        """What a block of labels and the values below it give."""
        pairs = F.zip_with(F.slice(s["labels"], F.lit(1), F.size(s["values"])), s["values"], lambda k, v: F.struct(k.alias("key"), v.alias("value")))
        return F.when((F.size(s["labels"]) >= least) & (F.size(s["values"]) >= 2), F.concat(s["out"], pairs)).otherwise(s["out"])

    def step(s: Column, x: Column) -> Column:
        started = F.size(s["values"]) > 0
        more = F.struct(F.concat(s["labels"], F.array(x["field"])).alias("labels"), s["values"].alias("values"), F.lit(True).alias("open"), s["out"].alias("out"))
        fresh = F.struct(F.array(x["field"]).alias("labels"), none.alias("values"), F.lit(True).alias("open"), closed(s).alias("out"))
        ended = F.struct(none.alias("labels"), none.alias("values"), F.lit(True).alias("open"), closed(s).alias("out"))
        taken = F.struct(s["labels"].alias("labels"), F.concat(s["values"], F.array(x["value"])).alias("values"), F.lit(True).alias("open"), s["out"].alias("out"))
        full = F.size(s["values"]) >= F.size(s["labels"])
        return (
            F.when(x["field"].isNotNull() & ~started, more.cast(state))
            .when(x["field"].isNotNull(), fresh.cast(state))
            .when(x["ends"] | full | (F.size(s["labels"]) < least), ended.cast(state))
            .when(x["value"].isNull(), s)
            .otherwise(taken.cast(state))
        )

    keys = lambda pairs: F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    firsts = lambda pairs: F.transform(keys(pairs), lambda k: F.filter(pairs, lambda p: p["key"] == k)[0])
    return F.map_from_entries(bound(F.aggregate(kinds, empty, step, closed), firsts))


def block(text: Column, aliases: list[str], stops: list[str], stop_patterns: tuple[str, ...] = ()) -> Column:
    """Lines from the first label on, its own value first, up to a stop label or a line that begins with a stop pattern."""
    lines = clean_lines(text)
    marked = F.transform(lines, lambda x: F.struct(x.alias("line"), leading_label(x, aliases).isNotNull().alias("begins"), value_beside(x, aliases).alias("beside"), (leading_label(x, stops).isNotNull() | x.rlike("(?iu)^(?:" + "|".join([*stop_patterns, "(?!)"]) + ")")).alias("stops")))
    state = "struct<on:int,out:array<string>>"
    empty = F.struct(F.lit(0).alias("on"), F.array().cast("array<string>").alias("out")).cast(state)

    def step(s: Column, x: Column) -> Column:
        begun = F.struct(F.lit(1).alias("on"), F.array_compact(F.array(x["beside"])).alias("out")).cast(state)
        more = F.struct(F.lit(1).alias("on"), F.concat(s["out"], F.array(x["line"])).alias("out")).cast(state)
        done = F.struct(F.lit(2).alias("on"), s["out"].alias("out")).cast(state)
        return F.when((s["on"] == 0) & x["begins"], begun).when((s["on"] == 1) & x["stops"], done).when(s["on"] == 1, more).otherwise(s)

    return unique_ci(F.aggregate(marked, empty, step, lambda s: s["out"]))


def meaningful(values: Column) -> Column:
    """The values that say something, tidied."""
    return F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.when(~is_placeholder(x), collapsed(x))), lambda x: x.isNotNull())


def count_meaningful(values: Column) -> Column:
    """How many values say something."""
    return F.size(F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda x: ~is_placeholder(x)))
