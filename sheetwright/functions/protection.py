"""Section 8 as one struct: protective equipment, engineering controls, hygiene, exposure limits, DNEL and PNEC.

All labels are marked in one pass over the flat text; what stands between a label and the next one is its value, cut
into sentences. Limits, DNELs and PNECs are the lines of 8.1 that name them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwright.functions import lexicon_sections as lex
from sheetwright.functions.fragments import sentences, thicknesses
from sheetwright.functions.pages import alternation, without_marks, without_page_headings, words
from sheetwright.functions.text import bound, clean_lines, holds_any, unique_ci, unused, without

LISTS = ["respiratory_protection", "hand_protection", "glove_materials", "glove_thickness", "eye_face_protection", "body_protection", "engineering_controls", "exposure_limits", "dnel", "pnec", "hygiene_measures"]
_NONE = "array<string>"


def flat(section: Column) -> Column:
    """The section on one line, without what repeats on pages and without revision dates."""
    text = without_marks(without_page_headings(F.replace(section, F.lit(""), F.lit("≥"))))
    return F.trim(F.regexp_replace(F.regexp_replace(text, "(?iU)" + "|".join(lex.REVISION_NOISE), " "), r"(?U)\s+", " "))


def tidy(value: Column) -> Column:
    """Without punctuation at the ends and page titles; words that ran together at a capital are parted."""
    out = F.regexp_replace(F.trim(F.regexp_replace(value, r"(?U)\s+", " ")), r"^[ :\-–—•·]+|[ :\-–—•·]+$", "")
    out = F.regexp_replace(out, r"(?<=[a-zçğıöşü])(?=[A-ZÇĞİÖŞÜ])", " ")
    out = F.trim(F.regexp_replace(F.regexp_replace(without_marks(out), f"(?iU){lex.PAGE_TITLE}", " "), r"(?U)\s+", " "))
    return bound(out, lambda x: F.when(~x.isin("", "-", "—", "/"), x))


def _holds(text: Column, words: list[str]) -> Column:
    return bound(F.lower(text), lambda low: holds_any(low, [w.strip() for w in words]))


def _listed(values: Column) -> Column:
    """Tidy values that hold no page heading, distinct."""
    each = F.transform(values, tidy)
    return unique_ci(F.filter(each, lambda x: x.isNotNull() & ~_holds(x, lex.HEADING_MARKERS)))


def content_lines(text: Column) -> Column:
    """Clean lines without page headings and noise."""
    noise = f"(?iU)^{alternation(lex.NOISE_LINES)}"
    return F.filter(clean_lines(without_page_headings(text)), lambda x: ~x.rlike(noise))


def _lines_with(lines: Column, words: list[str]) -> Column:
    return F.filter(lines, lambda x: _holds(x, words))


def _is_weak(line: Column) -> Column:
    """A table's heading without a measured limit, or a few words without a unit or kind of limit."""
    heading = _holds(line, lex.LIMIT_TABLE_WORDS) & ~line.rlike(f"(?iU){lex.LIMIT_MEASURE}")
    short = (F.size(F.split(line, " ")) < 5) & ~line.rlike(f"(?iU){lex.LIMIT_UNIT}")
    return heading | short


def first_part(section: Column) -> Column:
    """The text from 8.1 up to 8.2; from the start or to the end where a number is missing, all where they are turned."""
    whole = F.coalesce(section, F.lit(""))
    part = lambda n: rf"(?<!\d)8\s*\.\s*{n}\s*\.?(?!\d)"
    from_one = F.when(whole.rlike(part(1)), F.regexp_extract(whole, rf"(?s)({part(1)}.*)$", 1)).otherwise(whole)
    return F.when(whole.rlike(rf"(?s){part(2)}.*?{part(1)}") & ~whole.rlike(rf"(?s){part(1)}.*?{part(2)}"), whole).otherwise(F.element_at(F.split(from_one, part(2)), 1))


def with_protection(df: DataFrame, section: str, name: str = "protection") -> DataFrame:
    """``df`` with a struct of eleven lists found in the column ``section`` (null or empty: all empty)."""
    text, pairs, lists, first, all_ = unused(df, 5)
    every = [lex.PROTECTION_NUMBER + words([x for labels in lex.PROTECTION.values() for x in labels]), *lex.PROTECTION_ENDS]
    plain = df.withColumn(text, without(flat(F.coalesce(F.col(section), F.lit(""))), "\u0001", "\u0002"))
    pieces = F.filter(F.split(F.regexp_replace(F.col(text), rf"(?iU)({'|'.join(every)})", "\u0001$1\u0002"), "\u0001"), lambda p: F.contains(p, F.lit("\u0002")))
    field = F.lit(None).cast("string")

    def field_of(label: Column) -> Column:
        out = field
        for known, labels in lex.PROTECTION.items():
            out = F.when(label.rlike(f"(?iU){words(labels)}$"), F.lit(known)).otherwise(out)
        return out

    marked = F.transform(F.transform(pieces, lambda p: F.split(p, "\u0002")), lambda p: F.struct(field_of(p[0]).alias("field"), p[0].alias("label"), p[1].alias("raw"), tidy(p[1]).alias("value")))
    # Lines are made once, in columns of their own: three lists read those of 8.1.
    plain = plain.withColumns({pairs: marked, first: content_lines(first_part(F.col(section))), all_: content_lines(F.col(section))})
    value = lambda known: F.try_element_at(F.filter(pairs, lambda p: (p["field"] == known) & p["value"].isNotNull()), F.lit(1))["value"]
    cut = lambda known: sentences(value(known))
    none = F.array().cast(_NONE)
    equipment = [f for f in lex.PROTECTION if f not in ("engineering_controls", "environmental_controls")]
    # Engineering controls without a label: what follows 8.2 up to the first equipment label, if it names one.
    begins = lambda p: p["label"].rlike(r"^8\s*\.\s*2\s*\.?$")
    place = lambda array, test: F.array_position(F.transform(array, test), True).cast("int")
    later = bound(place(F.col(pairs), begins), lambda at: F.when(at > 0, F.slice(F.col(pairs), at, F.size(pairs))))
    before = lambda rest: bound(place(rest, lambda p: F.coalesce(p["field"].isin(equipment), F.lit(False))), lambda at: F.when(at > 0, F.slice(rest, F.lit(1), at - 1)).otherwise(rest))
    joined = tidy(F.array_join(F.transform(bound(later, before), lambda p: F.concat(F.when(begins(p), "").otherwise(p["label"]), p["raw"])), ""))
    joined = F.trim(F.regexp_replace(joined, rf"(?iU)^{words(lex.ENGINEERING_HEADINGS)}\s*:?\s*", ""))
    loose = bound(joined, lambda x: F.when((F.size(F.split(x, " ")) >= 3) & _holds(x, lex.ENGINEERING_WORDS), sentences(x)).otherwise(none))
    limits, lines = F.col(first), F.col(all_)
    or_else = lambda known, other: bound(cut(known), lambda x: F.when(F.size(x) > 0, x).otherwise(other))
    found = {
        **{f: _listed(cut(f)) for f in ("respiratory_protection", "hand_protection", "eye_face_protection", "body_protection")},
        "engineering_controls": _listed(or_else("engineering_controls", F.coalesce(loose, none))),
        "hygiene_measures": _listed(or_else("hygiene_measures", _lines_with(lines, lex.HYGIENE_WORDS))),
        "exposure_limits": _listed(F.filter(F.transform(_lines_with(limits, lex.LIMIT_WORDS), tidy), lambda x: x.isNotNull() & ~_is_weak(x))),
        "dnel": _listed(_lines_with(limits, lex.DNEL_WORDS)),
        "pnec": _listed(_lines_with(limits, lex.PNEC_WORDS)),
    }
    out = plain.withColumn(lists, F.struct(*[v.alias(k) for k, v in found.items()]))
    hand = F.col(f"{lists}.hand_protection")
    gloves = {"glove_materials": F.filter(hand, lambda x: _holds(x, lex.GLOVE_WORDS)), "glove_thickness": thicknesses(F.array_join(hand, " "))}
    return out.withColumn(name, F.struct(*[(gloves[f] if f in gloves else F.col(f"{lists}.{f}")).alias(f) for f in LISTS])).drop(text, pairs, lists, first, all_)
