"""Dates and versions of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwright.functions.codes import found
from sheetwright.functions.lexicon import MONTHS, PREPARATION_LABELS, REVISION_LABELS, VERSION_LABELS, VERSION_WORDS
from sheetwright.functions.text import bound, cases, fold, led, unused

_WORD = "[A-Za-zÇĞİÖŞÜçğıöşü]+"
_DATE = rf"\d{{1,2}}\s*[-./ ]\s*{_WORD}\s*[-./ ]\s*\d{{4}}|\d{{4}}[-/.]\d{{1,2}}[-/.]\d{{1,2}}|\d{{1,2}}[-/.]\d{{1,2}}[-/.]\d{{4}}|{_WORD}\s+\d{{1,2}}(?:st|nd|rd|th)?\s*,?\s*\d{{4}}"


def _date(year: Column, month: Column, day: Column) -> Column:
    """A date, or null where there is no such day."""
    # Only whole dates are parsed: each failure costs an exception inside Spark.
    whole = F.concat(year, F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0"))
    return bound(whole, lambda w: F.when(w.rlike(r"^\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])$"), F.try_to_date(w, "yyyy-MM-dd")))


def parse_date(value: Column) -> Column:
    """The first of four forms that is a valid date: Y-M-D, D-M-Y, D month Y, month D, Y."""
    text = F.coalesce(value, F.lit(""))
    months = F.create_map(*[F.lit(x) for name, n in MONTHS.items() for x in (name, str(n))])
    part = lambda pattern, i: F.regexp_extract(text, pattern, i)  # noqa: E731 - without a match no whole date comes about
    month = lambda pattern, i: F.try_element_at(months, F.regexp_replace(fold(F.regexp_extract(text, pattern, i)), "[^a-z]", ""))
    ymd = r"(?<!\d)(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?!\d)"
    dmy = r"(?<!\d)(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})(?!\d)"
    named = rf"(?<!\d)(\d{{1,2}})\s*[-./ ]\s*({_WORD})\s*[-./ ]\s*(\d{{4}})(?!\d)"
    leading = rf"(?i)(?<![A-Za-z])({_WORD})\s+(\d{{1,2}})(?:st|nd|rd|th)?\s*,?\s*(\d{{4}})"
    return F.coalesce(
        _date(part(ymd, 1), part(ymd, 2), part(ymd, 3)),
        _date(part(dmy, 3), part(dmy, 2), part(dmy, 1)),
        _date(part(named, 3), month(named, 2), part(named, 1)),
        _date(part(leading, 3), month(leading, 1), part(leading, 2)),
    )


_VALUE = r"[A-Za-z0-9._\-]+"


def lexed(labels: list[str]) -> str:
    """One pattern for many labels: by first letters, so that most places fail at once, and longer labels before shorter ones."""
    return led(sorted(labels, key=lambda x: -len(x)))


def date_tokens(text: Column, labels: list[str]) -> Column:
    """Every label with the date that follows it, in one pass over the text."""
    return found(text, rf"(?isU){lexed(labels)}\s*:?\s*(?:{_DATE})")


def version_tokens(text: Column) -> Column:
    """Every version label with the word that follows it, in one pass over the text."""
    return found(text, rf"(?iU){lexed(VERSION_LABELS)}\s*:?\s*{_VALUE}")


def _of_label(tokens: Column, label: str, value: str) -> Column:
    """The value of a label's first token."""
    whole = rf"(?isU)^{label}\s*:?\s*({value})$"
    return F.regexp_extract(F.try_element_at(F.filter(tokens, lambda t: t.rlike(whole)), F.lit(1)), whole, 1)


def date_of(tokens: Column, labels: list[str]) -> Column:
    """The date after the first label that one follows; of each label the first token is tried."""
    # Labels whose first letter begins no token are passed over.
    heads = F.array_join(F.transform(tokens, lambda t: F.left(t, F.lit(1))), "")
    raw = bound(heads, lambda h: F.array(*[F.when(h.rlike(f"[{cases(label[0])}]"), _of_label(tokens, label, _DATE)) for label in labels]))
    dates = F.array_compact(F.transform(F.filter(raw, lambda x: x != ""), parse_date))
    return F.when(F.size(tokens) > 0, F.try_element_at(dates, F.lit(1)))


def version_of(tokens: Column) -> Column:
    """The value after the first version label whose first token is no label word."""
    value = lambda label: bound(_of_label(tokens, label, _VALUE), lambda v: F.when((v != "") & ~F.lower(v).isin(VERSION_WORDS), v))
    return F.when(F.size(tokens) > 0, F.coalesce(*map(value, VERSION_LABELS)))


def version(text: Column) -> Column:
    """The version of a text; ``with_dates`` is the leaner form, since it makes tokens once."""
    return version_of(version_tokens(text))


def with_dates(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with ``revision_date``, ``preparation_date`` and ``version`` of ``text``: a pass for each, then tokens only."""
    names = unused(docs, 3)
    out = docs.withColumns({names[0]: date_tokens(text, REVISION_LABELS), names[1]: date_tokens(text, PREPARATION_LABELS), names[2]: version_tokens(text)})
    revised, prepared, versions = map(F.col, names)
    return out.withColumns({"revision_date": date_of(revised, REVISION_LABELS), "preparation_date": date_of(prepared, PREPARATION_LABELS), "version": version_of(versions)}).drop(*names)


def version_key(value: Column) -> Column:
    """All whole numbers in a version: such arrays are ordered as versions are. Null where there is none."""
    numbers = F.transform(found(value, r"(\d+)", 1), lambda n: n.try_cast("int"))
    return F.when(F.size(numbers) > 0, numbers)


def effective_date(revised: Column, prepared: Column) -> Column:
    return F.coalesce(revised, prepared)
