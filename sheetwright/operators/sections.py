"""Splitting a sheet into its sixteen sections, and judging what kind of document it is."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwright.functions.codes import found
from sheetwright.functions.lexicon import INSTRUCTION_MARKERS, NOT_CLASSIFIED, REFERENCE_STARTS, SCORE_CHEMISTRY, SCORE_HEADINGS, SCORE_TITLES, SECTION_TITLES, SHEET_MARKERS
from sheetwright.functions.text import MARKED, PLAIN, WHITE, bound, holds_any, unused, upper_plain, without

#: What may begin a section: a word with a number, a first subsection (n.1), or a number at a line's start.
_WORD = r"(?U:\b)(?iu:BÖLÜM|BOLUM|SECTION)(?U:\s*)(1[0-6]|[1-9])(?U:\s*)([:.\-]?)"
_FIRST = r"(^[ \t]*)?(?<!\d)(1[0-6]|[1-9])\s*\.\s*1\.?\s+"
_LINE = r"^[ \t]*(1[0-6]|[1-9])(?U:\s*)[.)\-:](?U:\s*)"
_ANY = rf"(?m)(?=[BSbs1-9 \t])(?:{_WORD}|{_FIRST}|{_LINE})"
#: Characters that follow a heading and are searched for its title: after a word, a line's number, a subsection.
WORD_REACH, LINE_REACH, FIRST_REACH = 160, 220, 300
_CUT, _FIELD = "\u0001", "\u0002"


def _loose(word: str) -> str:
    """A pattern for a fixed word whatever its marks, case and white space."""
    marks = {p: p + "".join(m for m, q in zip(MARKED, PLAIN, strict=True) if q == p) for p in set(PLAIN)}
    low = word.replace("I", "i").replace("İ", "i").replace("ı", "i").lower().translate(str.maketrans(MARKED, PLAIN)).strip()
    return "".join(r"\s+" if c == " " else f"[{marks[c]}]" if c in marks else re.escape(c) for c in low)


def _titled(number: Column, following: Column) -> Column:
    """A title word of section ``number`` occurs in the text after the heading (a stored value)."""
    out = F.lit(False)
    for n, words in SECTION_TITLES.items():
        out = F.when(number == n, following.rlike("(?iuU)" + "|".join(dict.fromkeys(map(_loose, words))))).otherwise(out)
    return out


def _following(parts: Column, i: Column, size: int) -> Column:
    """The ``size`` characters after part ``i``'s heading; what a short part lacks comes from those after it."""
    here = F.substring(parts[i]["rest"], 1, size)
    more = F.array_join(F.transform(F.slice(parts, i + 2, F.lit(8)), lambda p: p["lead"]), "")
    return F.when(F.length(parts[i]["rest"]) >= size, here).otherwise(F.substring(F.concat(here, more), 1, size))


def split_sections(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``sections``: map of section number to text, headings included.

    A heading is a word with a number, or a number at a line's start, whose title follows; mentions in running
    text and references are none. Of the headings the earliest of each number after the one before is taken. Where
    numbers are missing between two of them, a first subsection (n.1) whose title follows stands for the heading.
    Text before the first heading belongs to no section; empty sections are left out; a null text has none. The
    control characters U+0001 and U+0002 are dropped. Other columns stay as they are, whatever their names.

    One pass marks all candidates; the text is cut there once, and sections are put together from the pieces.
    """
    cut, near, found, chosen = unused(docs, 4)
    whole = without(F.coalesce(F.col(text).cast("string"), F.lit("")), _CUT, _FIELD)
    # Word number, its mark, number of a subsection, number of a line; the heading; what follows.
    marked = F.regexp_replace(whole, _ANY, _CUT + _FIELD.join(["$1", "$2", "$4", "$5", "$0"]) + _FIELD)
    pieces = F.transform(F.split(F.concat(F.lit(_FIELD * 5), marked), _CUT), lambda p: F.split(p, _FIELD))
    number = lambda p, k: F.when(p[k] != "", p[k].cast("int"))  # noqa: E731 - trying to cast empty strings costs an exception each
    # The head and what of the rest any heading before it may search; made once for all of these.
    lead = lambda p: F.concat(p[4], F.substring(p[5], 1, max(WORD_REACH, LINE_REACH, FIRST_REACH))).alias("lead")
    out = docs.withColumn(cut, F.transform(pieces, lambda p: F.struct(number(p, 0).alias("word"), p[1].alias("mark"), number(p, 2).alias("first"), number(p, 3).alias("line"), p[4].alias("head"), p[5].alias("rest"), lead(p))))
    parts = F.col(cut)

    def around(p: Column, i: Column) -> Column:
        """A candidate with the text after it and how it stands to the text before it."""
        raw = F.when(p["word"].isNotNull(), _following(parts, i, WORD_REACH)).otherwise(_following(parts, i, LINE_REACH))
        far = F.when(p["first"].isNotNull(), _following(parts, i, FIRST_REACH))
        before = F.substring(F.concat(parts[i - 1]["head"], parts[i - 1]["rest"]), -200, 200)
        n = F.coalesce(p["word"], p["line"], p["first"])
        at_start = F.when(p["word"].isNotNull(), ~F.substring_index(before, "\n", -1).rlike(r"[\p{L}\p{N}]")).otherwise(p["line"].isNotNull() | F.endswith(before, F.lit("\n")))
        return F.when(n.isNotNull(), F.struct(i.alias("at"), n.alias("n"), p["word"].isNotNull().alias("by_word"), p["mark"].alias("mark"), raw.alias("near"), far.alias("far"), at_start.alias("at_start")))

    out = out.withColumn(near, F.filter(F.transform(parts, around), lambda c: c.isNotNull()))

    def judged(c: Column) -> Column:
        refers = c["mark"].isin("", ".") & c["near"].rlike(r"(?iuU)^\s*(?:" + "|".join(map(_loose, REFERENCE_STARTS)) + ")")
        placed = F.when(c["by_word"], (c["mark"].isin(":", "-") | c["at_start"]) & ~refers).otherwise(c["at_start"])
        starts = c["far"].isNotNull() & _titled(c["n"], c["far"])
        return F.struct(c["at"].alias("at"), c["n"].alias("n"), (placed & _titled(c["n"], c["near"])).alias("is_heading"), starts.alias("is_first"))

    out = out.withColumn(found, F.filter(F.transform(near, judged), lambda c: c["is_heading"] | c["is_first"]))
    pick = lambda c: F.struct(c["at"].alias("at"), c["n"].alias("n"))
    none = F.array().cast("array<struct<at:int,n:int>>")
    # The candidates travel in the fold's state: a lambda that named the column would have it made again in each step.
    begin = F.struct(F.transform(F.filter(found, lambda c: c["is_heading"]), pick).alias("heads"), F.transform(F.filter(found, lambda c: c["is_first"]), pick).alias("firsts"), none.alias("out"))
    last = lambda acc, field, default: F.coalesce(F.try_element_at(acc["out"], F.lit(-1))[field], F.lit(default))

    def extend(acc: Column, n: Column) -> Column:
        """The next heading of number ``n``, and before it first subsections of the numbers that it leaves out."""
        later = F.slice(F.filter(acc["heads"], lambda c: (c["n"] == n) & (c["at"] > last(acc, "at", -1))), F.lit(1), F.lit(1))
        gap = F.filter(acc["firsts"], lambda c: (c["at"] > last(acc, "at", -1)) & (c["at"] < later[0]["at"]) & (c["n"] > last(acc, "n", 16)) & (c["n"] < n))
        rising = F.aggregate(gap, none, lambda a, c: F.when(F.coalesce(F.try_element_at(a, F.lit(-1))["n"], F.lit(0)) < c["n"], F.concat(a, F.array(c))).otherwise(a))
        between = F.when(F.size(later) > 0, rising).otherwise(none)
        return F.struct(acc["heads"].alias("heads"), acc["firsts"].alias("firsts"), F.concat(acc["out"], between, later).alias("out"))

    out = out.withColumn(chosen, F.aggregate(F.sequence(F.lit(1), F.lit(16)), begin, extend, lambda acc: acc["out"]))
    content = lambda begin_, end: F.array_join(F.transform(F.slice(parts, begin_ + 1, end - begin_), lambda p: F.concat(p["head"], p["rest"])), "")
    texts = F.transform(chosen, lambda c, i: F.struct(c["n"].alias("key"), F.btrim(content(c["at"], F.coalesce(F.try_element_at(chosen, i + 2)["at"], F.size(parts))), F.lit(WHITE)).alias("value")))
    sections = F.map_from_entries(F.filter(texts, lambda e: e["value"] != ""))
    return out.withColumn("sections", sections).drop(cut, near, found, chosen)


def section_rows(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """A row for each section: doc_id, section_number, content.

    The outer form keeps the optimizer from adding a filter on the map, which would make the map twice.
    """
    return docs.select(doc_id, F.explode_outer("sections").alias("section_number", "content")).where("section_number is not null")


def main_numbers(text: Column) -> Column:
    """Distinct section numbers from 1 to 16 that begin a line, ascending."""
    line = r"(?m)^[ \t]*(?=[BSbsſ1-9])(?iU:(?:BÖLÜM|BOLUM|SECTION)\s*(?:1[0-6]|[1-9])\b|(?:1[0-6]|[1-9])\s*[.):-]\s+\S)"
    return F.array_sort(F.array_distinct(F.transform(found(text, line), lambda x: F.regexp_extract(x, "(1[0-6]|[1-9])", 1).cast("int"))))


def upper_text(text: Column) -> Column:
    """A text as its markers are looked for."""
    return upper_plain(F.coalesce(text, F.lit("")))


def _upper(text: Column, upper: Column | None, use: Callable[[Column], Column]) -> Column:
    """``use`` of the text in upper case, which is made once however many words are looked for, or is a stored value."""
    return bound(upper_text(text), use) if upper is None else use(upper)


def document_type(text: Column, upper: Column | None = None) -> Column:
    """SDS, HAZARDOUS_MATERIAL_INSTRUCTION or UNKNOWN, by section numbers, title and markers; ``upper``: ``upper_text`` of the text, if a column has it."""
    named = lambda whole: sum((F.contains(whole, F.lit(m)).cast("int") for m in SHEET_MARKERS), F.lit(0)) >= 6
    title = lambda whole: holds_any(whole, SHEET_MARKERS[:1] + SHEET_MARKERS[2:3])

    def kind(whole: Column, count: Column) -> Column:
        sheet = (count >= 8) | (title(whole) & (count >= 4)) | named(whole)
        return F.when(sheet, "SDS").when(holds_any(whole, INSTRUCTION_MARKERS), "HAZARDOUS_MATERIAL_INSTRUCTION").otherwise("UNKNOWN")

    return _upper(text, upper, lambda whole: bound(F.size(main_numbers(text)), lambda count: kind(whole, count)))


def confidence(text: Column, sections: Column, upper: Column | None = None) -> Column:
    """How surely a text is a sheet: exact hundredths from 0 to 1; ``upper``: ``upper_text`` of the text, if a column has it."""
    count = F.size(sections)

    def said(whole: Column) -> Column:
        """What the words of a text give."""
        heads = sum((holds_any(whole, group).cast("int") for group in SCORE_HEADINGS), F.lit(0))
        headings = bound(heads, lambda n: F.when(n >= 6, 35).when(n >= 3, 20).otherwise(0))
        return F.when(holds_any(whole, SCORE_TITLES), 25).otherwise(0) + headings + F.when(holds_any(whole, SCORE_CHEMISTRY), 10).otherwise(0)

    total = sum((F.when(hit, n).otherwise(0) for hit, n in [(count >= 4, 10), (count >= 8, 15), (count >= 14, 15)]), _upper(text, upper, said))
    return (F.least(total, F.lit(100)) / 100).cast("decimal(3,2)")


def classification_status(section_2: Column, *evidence: Column) -> Column:
    """classified where any evidence (arrays or strings) is there, else not_classified by a marker, else unknown."""
    some = F.lit(False)
    for e in evidence:
        some = some | e
    low = F.lower(F.regexp_replace(F.coalesce(section_2, F.lit("")), r"(?U)\s+", " "))
    return F.when(some, "classified").when(bound(low, lambda x: holds_any(x, NOT_CLASSIFIED)), "not_classified").otherwise("unknown")
