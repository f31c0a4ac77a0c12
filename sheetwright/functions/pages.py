"""What repeats on every page, taken out of a section's text; and the parts of a section by their numbers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheetwright.functions.lexicon_sections import PAGE_ADDRESS, PAGE_HEADING_LINES, PAGE_LINES, PAGE_MARKS, PAGE_TITLE
from sheetwright.functions.text import without


def alternation(labels: list[str]) -> str:
    """Label patterns of which the first that fits at a place counts."""
    return "(?:" + "|".join(labels) + ")"


def spelled(word: str) -> str:
    """A pattern for a word of the lexicon: blanks, and those around slashes, dashes, dots of numbers and brackets, may vary."""
    out = re.sub(r"([.()])", r"\\\1", word)
    for plain, loose in ((" / ", r"\s*/\s*"), (" - ", r"\s*[-–—]\s*"), (" \\(", r"\s*\("), (" ", r"\s+")):
        out = out.replace(plain, loose)
    return re.sub(r"(?<=\d)\\\.(?=\d)", r"\\s*\\.\\s*", out)


def words(labels: list[str]) -> str:
    """An alternation of the lexicon's words, of which the first that fits at a place counts."""
    return alternation([rf"\b{spelled(w)}\b" if w.isupper() else spelled(w) for w in labels])


def without_page_headings(text: Column) -> Column:
    """Without page marks, without heading blocks (a title line to the next address line), and without header lines."""
    whole = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    block = rf"(?imU)^[^\n]*{PAGE_TITLE}(?:[^\n]*\n){{0,{PAGE_HEADING_LINES - 1}}}?[^\n]*{PAGE_ADDRESS}[^\n]*\n?"
    return F.regexp_replace(F.regexp_replace(whole, block, ""), rf"(?imU)^[^\S\n]*{alternation(PAGE_LINES)}[^\S\n]*$", "")


def on_one_line(text: Column) -> Column:
    """Without what repeats on pages, white space collapsed; a null text gives an empty one."""
    return F.trim(F.regexp_replace(without_page_headings(text), r"(?U)\s+", " "))


def without_marks(text: Column) -> Column:
    """Page marks within a line become blanks."""
    return F.regexp_replace(text, f"(?iU){alternation(PAGE_MARKS)}", " ")


def numbered_parts(section: Column, number: int, most: int) -> Column:
    """Map from 1 to ``most`` of the parts that begin with ``number.n``, numbers included.

    Numbers must rise: one that doesn't belongs to the part before it. Text before the first number belongs to none.
    """
    text = without(F.coalesce(section, F.lit("")), "\u0001", "\u0002")
    marked = F.regexp_replace(text, rf"(?<!\d){number}\s*\.\s*([1-{most}])\s*\.?(?!\d)", "\u0001$1\u0002$0")
    pieces = F.transform(F.split(marked, "\u0001"), lambda p: F.split(p, "\u0002"))
    kind = "array<struct<key:int,value:string>>"

    def step(done: Column, p: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        n = p[0].cast("int")
        longer = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["key"].alias("key"), F.concat(last["value"], p[1]).alias("value"))))
        return F.when(n > F.coalesce(last["key"], F.lit(0)), F.concat(done, F.array(F.struct(n.alias("key"), p[1].alias("value"))))).otherwise(longer).cast(kind)

    parts = F.aggregate(F.filter(pieces, lambda p: F.size(p) == 2), F.array().cast(kind), step)
    tidy = F.transform(parts, lambda e: F.struct(e["key"].alias("key"), F.regexp_replace(e["value"], r"(?U)^\s+|\s+$", "").alias("value")))
    return F.map_from_entries(F.filter(tidy, lambda e: e["value"] != ""))
