"""Text expressions: folding, normalisation, lines and ordered distinct values."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwright.functions.lexicon import CHARACTER_REPAIRS, LABEL_NAMES, NO_DATA, PLACEHOLDERS

#: Letters with marks and the letters under them, for matching.
MARKED, PLAIN = "çğıöşüâîûêéèáàäëïôóòúùñ", "cgiosuaiueeeaaaeiooouun"


def lower_tr(value: Column) -> Column:
    """Lower case by Turkish rules: I becomes ı, İ becomes i."""
    return F.lower(F.translate(value, "Iİ", "ıi"))


def fold(value: Column) -> Column:
    """For matching: lower case, ı as i, letters without marks, white space collapsed, ends trimmed."""
    plain = F.translate(F.lower(F.translate(value, "Iİı", "iii")), MARKED, PLAIN)
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def upper_plain(value: Column) -> Column:
    """Upper case without a locale, white space collapsed: i becomes I."""
    return F.upper(F.regexp_replace(value, WHITE_RUNS, " "))


#: All white space of Unicode.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs of white space, without single blanks, which stay as they are.
WHITE_RUNS = r"(?U)\s(?:\s+|(?<! ))"


def unused(df: DataFrame, count: int) -> list[str]:
    """``count`` column names that ``df`` doesn't have, for values on the way."""
    taken = {c.lower() for c in df.columns}
    free = (f"tmp_{i}" for i in range(len(taken) + count))
    return [name for name in free if name not in taken][:count]


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once. A lambda that names an expression has it made again for each element;
    the element of an array of one is a variable, which isn't.
    """
    return F.transform(F.array(value), use)[0]


def filled(value: Column) -> Column:
    """The value, or null where it is empty; made once (``nullif`` makes it twice within a lambda)."""
    return bound(value, lambda v: F.when(v != "", v))


def without(value: Column, *marks: str) -> Column:
    """Without the given characters."""
    for mark in marks:
        value = F.replace(value, F.lit(mark), F.lit(""))
    return value


#: Letters that Unicode takes for equal whatever the case, where that is more than two.
_EQUAL = ["iIıİ", "sSſ", "kK\u212a", "åÅ\u212b", "µμΜ", "ßẞ"]


def cases(letter: str) -> str:
    """The characters that a letter equals whatever the case, for use within brackets."""
    every = next((group for group in _EQUAL if letter in group), "".join(dict.fromkeys((letter.lower(), letter.upper()))))
    return every if every.isalnum() else f"\\{letter}"


def _branched(words: list[str]) -> str:
    """A pattern of plain classes for fixed words whatever their case, common beginnings once."""
    tails: dict[str, list[str]] = {}
    for word in words:
        if word:
            tails.setdefault(cases(word[0]), []).append(word[1:])
    leads: dict[str, str] = {}
    for lead, rest in tails.items():
        tail = _branched(rest)
        leads[tail] = leads.get(tail, "") + lead
    parts = [f"[{lead}]{tail}" for tail, lead in leads.items()] + [""] * ("" in words)
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def caseless(words: list[str]) -> str:
    """A pattern for fixed words whatever their case. It may find a shorter word where a longer one stands: for look aheads."""
    return f"(?-iU:{_branched(words)})"


def _begins(words: list[str], most: int) -> list[str]:
    """The letters and digits that words or patterns begin with, one of them at least; longer ones left out where a shorter one says it."""
    begins = []
    for word in words:
        plain = next((i for i, c in enumerate(word) if i and not c.isalnum()), len(word))
        # What a quantifier follows needn't be there.
        begins.append(word[: max(1, min(most, plain - (word[plain : plain + 1] in ("?", "*", "{"))))])
    return [w for w in dict.fromkeys(begins) if not any(w != o and w.startswith(o) for o in begins)]


def sifted(words: list[str], most: int = 8) -> str:
    """A look ahead that only places pass where one of the words may begin, judged by the letters before its first other sign.

    Plain classes cost a tenth of what letters cost that are compared whatever their case, so most places fail at once.
    """
    kept = _begins(words, most)
    return f"(?-iU:(?=[{''.join(dict.fromkeys(cases(w[0]) for w in kept))}])(?={_branched(kept)}))"


def led(patterns: list[str], ahead: str = "", most: int = 8) -> str:
    """An alternation of patterns that begin with letters, in their order, for use whatever the case.

    The first letters, two if all patterns have them, are taken by plain classes, and nothing else is tried where these
    fail, which is most places. ``ahead`` is what has to hold before the match.
    """
    begins = _begins(patterns, most)
    taken = 2 if all(len(w) > 1 for w in begins) else 1
    classes = ["".join(dict.fromkeys(c for w in begins for c in cases(w[i]))) for i in range(taken)]
    tails: dict[str, list[str]] = {}
    for pattern in patterns:
        tails.setdefault("".join(f"[{cases(c)}]" for c in pattern[:taken]), []).append(pattern[taken:])
    rest = [w[taken:] for w in begins]
    sift = "" if "" in rest else f"(?={_branched(rest)})"
    branches = "|".join(f"(?<=(?-iU:{lead}))(?:{'|'.join(tail)})" for lead, tail in tails.items())
    before = f"(?<={ahead}.{{{taken}}})" if ahead else ""
    return "(?-iU:" + "".join(f"[{c}]" for c in classes) + f"{sift}){before}(?:{branches})"


def nfkc(value: Column) -> Column:
    """Unicode compatibility form, by the Unicode library that comes with Spark: no Python worker takes part."""
    composed = lambda v: F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), v, F.lit(True))
    return bound(value, lambda v: F.when(v.isNotNull(), composed(v)))


def repaired(value: Column) -> Column:
    """Characters that extraction breaks, put right; texts without any are passed through."""
    single = {k: v for k, v in CHARACTER_REPAIRS.items() if len(k) == 1 and len(v) == 1}
    leads = "".join(sorted({rf"\u{ord(k[0]):04X}" for k in CHARACTER_REPAIRS}))
    # Characters that none of them are fail by one comparison.
    low = rf"(?![\x00-\x{min(ord(k[0]) for k in CHARACTER_REPAIRS) - 1:02x}])"

    def mended(text: Column) -> Column:
        out = F.translate(text, "".join(single), "".join(single.values()))
        for old, new in CHARACTER_REPAIRS.items():
            out = out if old in single else F.replace(out, F.lit(old), F.lit(new))
        return F.when(text.rlike(f"{low}[{leads}]"), out).otherwise(text)

    return bound(value, mended)


def holds_any(text: Column, words: list[str]) -> Column:
    """One of the words occurs in the text (a stored value)."""
    return reduce(or_, [F.contains(text, F.lit(word)) for word in dict.fromkeys(words)])


def where_held(value: Column, marks: list[str], use: Callable[[Column], Column]) -> Column:
    """``use(value)`` where one of the marks occurs in the value, else the value as it is: looking for a mark is much cheaper than a pattern."""
    return bound(value, lambda v: F.when(holds_any(v, marks), use(v)).otherwise(v))


def line_ends(value: Column) -> Column:
    """One kind of line end."""
    return where_held(value, ["\r"], lambda v: F.regexp_replace(v, r"\r\n?", "\n"))


def tidy_lines(value: Column) -> Column:
    """One kind of line end, single blanks within lines, none at their ends, three empty lines at most."""
    out = where_held(line_ends(value), [" \n", "\t\n"], lambda v: F.regexp_replace(v, r"[ \t]+\n", "\n"))
    out = where_held(out, ["  ", "\t"], lambda v: F.regexp_replace(v, r"[ \t]+", " "))
    return F.btrim(where_held(out, ["\n" * 4], lambda v: F.regexp_replace(v, r"\n{4,}", "\n\n\n")), F.lit(WHITE))


def normalised(value: Column) -> Column:
    """A document's text as all extraction reads it."""
    return tidy_lines(nfkc(repaired(value)))


#: What DuckDB's trim takes from a text's ends: Unicode's spaces, without tabs and line ends.
SPACES = " \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def one_line(value: Column, runs: str = WHITE_RUNS, ends: str = " ") -> Column:
    """Runs of white space as one blank, then none of ``ends`` at the ends; a text without anything else is empty, not null."""
    return F.btrim(F.regexp_replace(value, runs, " "), F.lit(ends))


def collapsed(value: Column) -> Column:
    """White space collapsed and trimmed; nothing left is null."""
    return filled(one_line(value))


def preview(value: Column, most: int = 700, mark: str = "\n...[DEVAMI KESİLDİ]...") -> Column:
    """A trimmed text, cut with a mark beyond ``most`` characters."""
    whole = F.regexp_replace(value, r"(?U)^\s+|\s+$", "")
    return F.when(F.length(whole) <= most, whole).otherwise(F.concat(F.left(whole, F.lit(most)), F.lit(mark)))


def value_list(values: Column) -> Column:
    """An array without null and empty values; a null array is empty. Order and repeated values stay."""
    return F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda x: x != "")


def clean_line(line: Column) -> Column:
    """A line without bullets and surplus blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(line, r"(?U)\s+", " "), r"^[ •●▪■◦*·–—-]+", ""))


def clean_lines(value: Column) -> Column:
    """Lines without bullets and surplus blanks; empty ones dropped."""
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), "\n"), clean_line), lambda x: x != "")


def unique_ci(values: Column, key=F.lower) -> Column:
    """Trimmed values, the first spelling of each, in order; ``key`` says what counts as equal."""
    trimmed = F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    # Distinct keys keep their order, and the first place of each is that of its first spelling.
    first_of = lambda t, keys: F.transform(F.array_distinct(keys), lambda k: F.element_at(t, F.array_position(keys, k).cast("int")))
    return bound(trimmed, lambda t: bound(F.transform(t, lambda x: key(x)), lambda keys: first_of(t, keys)))


def is_placeholder(value: Column) -> Column:
    """Null, one of the placeholders, or punctuation only."""
    tidy = lambda v: F.trim(F.regexp_replace(v, r"(?U)\s+", " "))
    empty = lambda v: bound(tidy(v), lambda t: t.isin(PLACEHOLDERS) | t.rlike(r"^[:\-–—._/\s]+$"))
    return bound(value, lambda v: v.isNull() | empty(v))


def says_no_data(value: Column) -> Column:
    """One of the markers for missing data occurs."""
    low = F.lower(F.coalesce(collapsed(value), F.lit("")))
    return bound(low, lambda x: F.exists(F.array(*map(F.lit, NO_DATA)), lambda m: F.contains(x, m)))


def is_suspicious_name(value: Column) -> Column:
    """A manufacturer that is missing, a label, or shorter than four characters."""
    return bound(collapsed(value), lambda v: v.isNull() | F.lower(v).isin(LABEL_NAMES) | (F.length(v) < 4))
