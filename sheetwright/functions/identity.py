"""Product name and manufacturer of a sheet, from section 1 or else from the lines of the whole text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwright.functions.lexicon import MAKER_ENDS, MAKER_LABELS, MAKER_LINE_LABELS, MAKER_PREFIXES, NAME_ENDS, NAME_LABELS, NAME_LINE_LABELS, NOT_MAKERS
from sheetwright.functions.text import bound, is_suspicious_name, unused

_LINE_ENDS = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x85\u2028\u2029]"
_DECORATION = r"\-–—•·ꞏ*_:|/\\"
#: Lines of a text that are searched where section 1 says nothing.
NAME_LINES, MAKER_LINES = 300, 400


def _any(labels: list[str]) -> str:
    return "(?:" + "|".join(labels) + ")"


def _in_turn(labels: list[str]) -> str:
    """Each label once at most, in their order."""
    return "(?:" + "".join(rf"(?:{label}\s*:?\s*)?" for label in labels) + ")"


def _first(values: Column) -> Column:
    return F.try_element_at(F.filter(values, lambda x: x != ""), F.lit(1))


def _undecorated(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(value, r"(?U)\s+", " "), rf"^[\s{_DECORATION}]+", ""))


def _clean_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(line, r"(?U)^\s*(?:[*\-·•]+\s*)?", ""), r"(?U)\s+", " "))


def _name_value(value: Column) -> Column:
    """Cut where the next label begins, without an echo of its own label."""
    cut = F.trim(F.regexp_replace(_undecorated(value), rf"(?iU)\s+(?={_any(NAME_ENDS)}).*", ""))
    return _undecorated(F.regexp_replace(cut, rf"(?iU)^{_any(NAME_LABELS)}\s*:?\s*", ""))


def _tidy_name(value: Column) -> Column:
    """Without labels in front, in four rounds at most."""
    return F.trim(F.regexp_replace(_clean_line(value), rf"(?iU)^{_in_turn(NAME_LINE_LABELS)}{{0,4}}", ""))


def _tidy_maker(value: Column) -> Column:
    return F.trim(F.regexp_replace(_clean_line(value), rf"(?iU)^{_in_turn(MAKER_PREFIXES)}", ""))


def product_name(section: Column, text: Column) -> Column:
    """The value of the first label, in label order, that has one; else the first labelled line of the text.

    A label begins a line and its value may stand on the next; only where no label does so, one inside a
    line counts. Ends of values need no word boundary.
    """
    held = F.coalesce(section, F.lit(""))
    lines = F.array(*[F.regexp_extract(held, rf"(?imdU)^\s*[{_DECORATION}]*\s*{label}\s*:?\s*(.+?)\s*$", 1) for label in NAME_LABELS])
    inside = F.regexp_extract(held, rf"(?isdU){_any(NAME_LABELS)}\s*:?\s*(.+?)(?=\n|{'|'.join(NAME_ENDS)}|$)", 1)
    found = F.coalesce(_first(F.transform(F.filter(lines, lambda x: x != ""), _name_value)), _name_value(inside))
    top = F.slice(F.split(F.coalesce(text, F.lit("")), _LINE_ENDS), 1, NAME_LINES)
    labelled = F.transform(top, lambda x: _tidy_name(F.regexp_extract(_clean_line(x), rf"(?iU)^{_any(NAME_LINE_LABELS)}\s*:?\s*(.+)$", 1)))
    return F.coalesce(_first(F.array(_tidy_name(found))), _first(labelled))


def _maker_value(value: Column) -> Column:
    """Without address and numbers; empty where it is a part of a label, an address or a number."""
    cut = F.trim(F.regexp_replace(_undecorated(value), rf"(?iU)\s+(?={_any(MAKER_ENDS)}).*", ""))
    listed = lambda low: low.isin(NOT_MAKERS) | F.startswith(low, F.lit("undertaking"))
    no_name = lambda cut: bound(F.lower(cut), listed) | cut.rlike(r"(?iU)@|^(?:https?://)?(?:www\.)?\S+\.\S+$|^[+\d()\s./\-]+$")
    return bound(cut, lambda c: F.when(no_name(c), "").otherwise(c))


def with_manufacturer(docs: DataFrame, section: Column, text: Column) -> DataFrame:
    """``docs`` with ``manufacturer``: after a label and a colon in section 1, or on one of the three lines below a
    label that stands alone; where that is suspicious, beside or below a label in the lines of the text, or null.
    """
    lines = F.transform(F.filter(F.split(F.coalesce(section, F.lit("")), _LINE_ENDS), lambda x: x.rlike(r"(?U)\S")), _undecorated)
    kept, maker = unused(docs, 2)
    out = docs.withColumn(kept, lines)

    def beside_or_below(x: Column, i: Column) -> Column:
        beside = F.filter(F.array(F.regexp_extract(x, rf"(?iU)^{_any(MAKER_LABELS)}\s*:\s*(.+)$", 1)), lambda v: v != "")
        below = F.transform(F.slice(kept, i + 2, F.lit(3)), _maker_value)
        return F.when(x.rlike(rf"(?iU)^{_any(MAKER_LABELS)}\s*:?$"), below).otherwise(F.transform(beside, _maker_value))

    out = out.withColumn(maker, _tidy_maker(_first(F.flatten(F.transform(kept, beside_or_below)))))
    doubtful = is_suspicious_name(F.col(maker))
    top = F.transform(F.slice(F.split(F.coalesce(text, F.lit("")), _LINE_ENDS), 1, MAKER_LINES), _clean_line)
    out = out.withColumn(kept, F.when(doubtful, top))

    def labelled(x: Column, i: Column) -> Column:
        label = rf"(?iU)^{_any(MAKER_LINE_LABELS)}\s*:?\s*(.*)$"
        both = F.array(_tidy_maker(F.regexp_extract(x, label, 1)), _tidy_maker(F.try_element_at(kept, (i + 2).cast("int"))))
        return F.when(x.rlike(label), both).otherwise(F.array().cast("array<string>"))

    other = F.filter(F.flatten(F.transform(kept, labelled)), lambda x: ~is_suspicious_name(x))
    return out.withColumn("manufacturer", F.when(doubtful, F.try_element_at(other, F.lit(1))).otherwise(F.col(maker))).drop(kept, maker)
