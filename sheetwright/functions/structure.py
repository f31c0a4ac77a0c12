"""Structure normaliser: what ran together stands on lines of its own again.

Everything before which a line has to end is an alternative of one pattern: page marks and what follows them, long
rules, headings, numbered parts, known labels. A text is scanned once for all of them; what is found is the blank space
in front, which becomes a line end. Other steps put values, codes and split words right.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheetwright.functions.fragments import joined_hazard_codes, joined_p_groups
from sheetwright.functions.lexicon_sections import BAD_SPLIT_STEMS, BAD_SPLITS, JOINED_VALUES, PROPERTY_NAMES, STRUCTURE_LABELS
from sheetwright.functions.pages import alternation, spelled
from sheetwright.functions.text import bound, caseless, holds_any, led, line_ends, where_held


def quoted(words: list[str]) -> str:
    """An alternation of fixed words, longer ones first."""
    return "(?:" + "|".join(rf"\Q{w}\E" for w in sorted({w.strip() for w in words}, key=lambda w: (-len(w), w))) + ")"


_WORDS = [w.strip() for group in (*STRUCTURE_LABELS.values(), *PROPERTY_NAMES.values()) for w in group]
_LABEL = caseless(_WORDS)
_PAGE = r"---\s{0,9}PAGE\s{1,9}\d{1,9}\s{0,9}---"
_NUMBER = r"(?:1[0-6]|[1-9])(?:\.\d{1,2}){1,3}\.?"
_HEADING = r"(?:BÖLÜM|BOLUM|SECTION)\s*(?:1[0-6]|[1-9])\s*:"
#: Space before which, or in whose place, a line ends. The group keeps a number; a blank behind it is doubled.
LINE_ENDS = [
    rf"\s+(?={_PAGE})|(?=-)(?<!\s)(?={_PAGE})",
    rf"(?<=---)(?<={_PAGE})(?:\s+|(?!\s))",
    "_{20,}",
    rf"[ \t]+(?={_HEADING})|(?=(?-i:[BSbsſ]))(?<![ \t])(?={_HEADING})",
    rf"(?<![\d.])[ \t]+({_NUMBER})(?=([ \t]))",
    rf"[ \t]+(?={_LABEL}(?:[ \t\n:]|$))",
]
#: The same for texts without page marks and rules. It begins with one plain class, so that most places fail at once; the first letter of a heading is kept.
PLAIN_ENDS = r"[ \tBSbs\u017F](?iu)(?:(?<=[ \t])(?:[ \t]*(?={0}|{1}(?:[ \t\n:]|$))|(?<![\d.][ \t])[ \t]*({2})(?=([ \t])))|(?<![ \t].)(?<=(?={0})(.)))".format(_HEADING, _LABEL, _NUMBER)


def lines_marked(text: Column) -> Column:
    """A new line wherever one has to begin. A section without its colon is a mere reference, and words that only hold
    a label (``renksiz``, ``DNELs``) stay whole."""
    every = lambda whole: F.regexp_replace(whole, "(?iu)" + alternation(LINE_ENDS), "\n$1$2")
    return bound(text, lambda whole: F.when(holds_any(whole, ["---", "_" * 20]), every(whole)).otherwise(F.regexp_replace(whole, PLAIN_ENDS, "\n$1$2$3")))


def values_apart(text: Column) -> Column:
    """A colon between a label and the value that is stuck to it."""
    stuck = led([rf"{spelled(label)}(?={alternation(values)}\b)" for label, values in JOINED_VALUES.items()], r"(?<!\w)")
    return F.regexp_replace(text, f"(?iU)({stuck})", "$1: ")


def splits_repaired(text: Column) -> Column:
    """Words that were split at a label inside them, put right."""
    pattern = lambda split: r"\b" + split.replace(":", r"\s*:\s*") + ("" if split in BAD_SPLIT_STEMS else r"\b")
    every = [*BAD_SPLITS, *BAD_SPLIT_STEMS]

    def mended(whole: Column) -> Column:
        out = whole
        for split in every:
            out = F.regexp_replace(out, f"(?iU){pattern(split)}", split.replace(":", ""))
        return F.when(whole.rlike("(?iU)" + led([pattern(s).removeprefix(r"\b") for s in every], r"\b")), out).otherwise(whole)

    return bound(text, mended)


def tidy(text: Column) -> Column:
    """Lines without blanks at their ends, one empty line in a row at most, none at the text's ends."""
    lines = F.btrim(where_held(text, [" \n", "\t\n", "\n ", "\n\t"], lambda v: F.regexp_replace(v, r"[ \t]*\n[ \t]*", "\n")), F.lit(" \t"))
    return F.btrim(where_held(lines, ["\n\n\n"], lambda v: F.regexp_replace(v, r"\n{3,}", "\n\n")), F.lit("\n"))


def structured(text: Column) -> Column:
    """A text with its structure; a null text gives an empty one."""
    plain = where_held(line_ends(F.coalesce(text, F.lit(""))), ["  ", "\xa0", "\t"], lambda v: F.regexp_replace(v, r"[ \xa0\t]+", " "))
    marked = lines_marked(values_apart(plain))
    codes = joined_hazard_codes(joined_p_groups(F.regexp_replace(marked, r"[Pp](?<=\b[Pp])\s*(\d{3})\b", "P$1")))
    return tidy(splits_repaired(codes))
