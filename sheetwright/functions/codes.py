"""Identifiers and hazard codes as array expressions over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheetwright.functions.lexicon import HAZARD_SUFFIXES, PICTOGRAMS, PRODUCT_CODE_LABELS
from sheetwright.functions.text import bound, filled, unique_ci


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches of ``pattern`` in order; none in a null text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def first(text: Column, pattern: str, group: int = 1) -> Column:
    """The group in the first match, trimmed; null where there is none."""
    return filled(F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, group)))


def cas_is_valid(cas: Column) -> Column:
    """The shape of a CAS number and its check digit: digits weighted by their place from the right, mod 10."""
    body = F.reverse(F.replace(F.regexp_extract(cas, r"^(\d{2,7}-\d{2})-\d$", 1), F.lit("-"), F.lit("")))
    digits = F.filter(F.split(body, ""), lambda c: c != "")
    total = F.aggregate(F.transform(digits, lambda c, i: c.cast("int") * (i + 1)), F.lit(0), lambda a, x: a + x)
    return F.coalesce(cas.rlike(r"^\d{2,7}-\d{2}-\d$") & (total % 10 == F.right(cas, F.lit(1)).try_cast("int")), F.lit(False))


def cas_numbers(text: Column) -> Column:
    """Valid CAS numbers that no digit or hyphen touches, distinct, in order."""
    return F.array_distinct(F.filter(found(text, r"(?<![\d-])\d{2,7}-\d{2}-\d(?![\d-])"), cas_is_valid))


def ec_number(text: Column) -> Column:
    """The first labelled EC number."""
    return first(text, r"(?iU)\b(?:EC|EG|EINECS)(?:\s*[-.]?\s*(?:No|Nr|Number|Numarası))?\.?\s*:?\s*(\d{3}-\d{3}-\d)(?!\d)")


def ec_numbers(text: Column) -> Column:
    """All labelled EC numbers, distinct, label by label."""
    number = r"\s*[:\-]?\s*(\d{3}-\d{3}-\d)\b"
    labels = [rf"\bEC\s*(?:number|no\.?|numarası|numarasi)?{number}", r"\bEC-No\.?\s*:\s*(\d{3}-\d{3}-\d)\b", rf"\bEG\s*(?:number|no\.?|numarası|numarasi)?{number}", rf"\bEINECS\s*(?:number|no\.?)?{number}"]
    return F.array_distinct(F.flatten(F.array(*[found(text, f"(?iU){label}", 1) for label in labels])))


def reach_numbers(text: Column) -> Column:
    """REACH registration numbers, distinct, in order."""
    return F.array_distinct(found(text, r"(?<!\d)\d{2}-\d{10}-\d{2}-\d{4}(?!\d)"))


def ufis(text: Column) -> Column:
    """Unique formula identifiers, upper case, distinct, in order."""
    return F.array_distinct(F.transform(found(text, r"(?i)(?<![A-Z0-9])[A-Z0-9]{4}(?:-[A-Z0-9]{4}){3}(?![A-Z0-9])"), F.upper))


def product_code(text: Column) -> Column:
    """The code after the first of the labels, in their order, that stands in the text."""
    return F.coalesce(*[first(text, rf"(?iU){label}\s*:?\s*([A-Z0-9][A-Z0-9._/\-]*)") for label in PRODUCT_CODE_LABELS])


def hazard_codes(text: Column) -> Column:
    """H codes in canonical spelling; a letter suffix that isn't official rejects the code, EUH codes don't count."""
    parts = found(text, r"(?i)(?<![A-Z0-9ÇĞİÖŞÜ])(?<!EU)H\s*\d{3}[A-Z]{0,2}(?![A-Z0-9])")
    bare = F.transform(parts, lambda c: F.upper(F.regexp_replace(c, r"\s+", "")))
    known = F.create_map(*[F.lit(x) for number, suffixes in HAZARD_SUFFIXES.items() for s in suffixes for x in (f"H{number}{s.upper()}", f"H{number}{s}")])
    spelled = F.transform(bare, lambda c: F.when(F.length(c) == 4, c).otherwise(F.try_element_at(known, c)))
    return F.array_distinct(F.array_compact(spelled))


def precautionary_codes(text: Column) -> Column:
    """P codes and their groups as ``P305+P351``; no boundary is needed on the left."""
    groups = found(text, r"(?i)P\s*\d{3}(?:\s*\+\s*P?\s*\d{3})*(?!\d)")
    joined = F.transform(groups, lambda g: F.array_join(F.transform(F.regexp_extract_all(g, F.lit(r"(\d{3})"), F.lit(1)), lambda n: F.concat(F.lit("P"), n)), "+"))
    return F.array_distinct(joined)


def signal_word(text: Column) -> Column:
    """The first labelled signal word, in canonical case."""
    word = first(text, r"(?iU)(?:Uyarı\s+kelimesi|Signal\s+word)\s*:?\s*(Tehlike|Dikkat|Danger|Warning)")
    return F.initcap(word)


def pictograms(text: Column) -> Column:
    """Explicit GHS pictogram codes as ``GHS0n``, distinct, in order."""
    return F.array_distinct(F.transform(found(text, r"(?i)(?<![A-Z])GHS\s*0?([1-9])(?!\d)", 1), lambda n: F.concat(F.lit("GHS0"), n)))


def implied_pictograms(codes: Column) -> Column:
    """Pictograms that exact hazard codes imply, distinct, in the order of the codes."""
    table = F.create_map(*[F.lit(x) for pair in PICTOGRAMS.items() for x in pair])
    return F.array_distinct(F.array_compact(F.transform(codes, lambda c: F.try_element_at(table, c))))


def component_names(text: Column) -> Column:
    """Names on the line below a composition heading, or after a label, distinct, in order."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    heading = r"(?iU)^(?:Kimyasal\s+yap[ıi]s[ıi]|Kimyasal\s+özellikleri|Chemical\s+composition)\s*:?$"
    label = r"(?iU)^(?:Kimyasal\s+ad[ıi]|Madde\s+ad[ıi](?:\s*\([^)]*\))?|Chemical\s+name|Substance\s+name)\s*:?\s*(.+)$"
    name = lambda all_: lambda x, i: F.array(F.when(x.rlike(heading), F.try_element_at(all_, (i + 2).cast("int"))), F.regexp_extract(x, label, 1))
    return unique_ci(F.flatten(bound(lines, lambda all_: F.transform(all_, name(all_)))))
