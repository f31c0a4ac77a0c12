"""Physical properties of section 9 as one struct.

All labels are marked in one pass over the flat text; what stands between a label and the next one is its value, so a
label inside a longer one doesn't count. Tables whose columns ran together leave unit, condition and number in the
order of the columns: one small grammar of number, unit and condition puts them in reading order for every measured
property.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwright.functions.codes import first
from sheetwright.functions.lexicon import DENSITY_UNITS, FOREIGN_MARKERS, FOREIGN_PROPERTY_MARKERS, NEAR_PERCENT, NO_VALUE_NOTES, PRESSURE_UNITS, PROPERTY_ECHOES, PROPERTY_ENDS, PROPERTY_LABELS, PROPERTY_NOTES, PROPERTY_TABLE_HEADINGS, SPLIT_SENTENCE, VISCOSITY_UNITS
from sheetwright.functions.lexicon_sections import PAGE_MARKS, REVISION_NOISE
from sheetwright.functions.text import bound, collapsed, sifted, unused, without

#: A number with a comparison before it and a range after it.
_NUMBER = r"(?:[<>≤≥~]|yaklaşık)?\s*\d+(?:[.,]\d+)?(?:\s*[-–]\s*\d+(?:[.,]\d+)?)?"
#: The condition a table names beside a unit: ``@ 30°C`` or ``20°C / 4°C``.
_AT = r"@\s*(\S+)"
_DEGREES = r"\d+(?:[.,]\d+)?\s*[°˚]?C"
_BOTH = rf"({_DEGREES}\s*/\s*{_DEGREES})"


def _any(labels: list[str]) -> str:
    """An alternation in which longer labels come first."""
    return "(?:" + "|".join(sorted(labels, key=len, reverse=True)) + ")"


def flat(section: Column) -> Column:
    """A section on one line, without page marks, table headings and revision dates."""
    noise = [*PAGE_MARKS, *PROPERTY_TABLE_HEADINGS, *REVISION_NOISE]
    return F.coalesce(collapsed(F.regexp_replace(section, "(?iU)" + "|".join(noise), " ")), F.lit(""))


def labelled(text: Column) -> Column:
    """The labels of a flat text with the text after each: array of struct(field, raw, value, ahead).

    ``field`` is null for labels that only end a value, ``value`` the tidy text, ``ahead`` the text before the label.
    """
    every = [x for labels in PROPERTY_LABELS.values() for x in labels] + PROPERTY_ENDS
    marked = F.regexp_replace(without(text, "\u0001", "\u0002"), rf"(?iU){sifted(every)}(?<!\w)({_any(every)})(?!\w)", "\u0001$1\u0002")
    pieces = F.transform(F.split(F.concat(F.lit("\u0002"), marked), "\u0001"), lambda p: F.split(p, "\u0002"))

    def field_of(label: Column) -> Column:
        out = F.lit(None).cast("string")
        for field, labels in PROPERTY_LABELS.items():
            out = F.when(label.rlike(rf"(?iU)^{_any(labels)}$"), F.lit(field)).otherwise(out)
        return out

    described = lambda all_: lambda p, i: F.struct(field_of(p[0]).alias("field"), p[0].alias("label"), p[1].alias("raw"), tidy_value(p[1]).alias("value"), F.when(i > 0, all_[i - 1][1]).alias("ahead"))
    return bound(pieces, lambda all_: F.transform(all_, described(all_)))


def tidy_value(value: Column) -> Column:
    """Without table marks, notes and punctuation at the ends; a minus sign stays. Nothing left is null."""
    out = F.regexp_replace(F.regexp_replace(value, "[ꞏ▤▪■]+", " "), r"(?U)\s+", " ")
    out = F.regexp_replace(out, r"^[ :;–—•·]+|[ :;–—•·]+$", "")
    out = F.trim(F.regexp_replace(out, rf"(?iU)(?<=\S)\s*{_any(PROPERTY_NOTES)}.*$", ""))
    return bound(out, lambda x: F.when(~x.isin("", "/", "-"), x))


def is_foreign(field: str, value: Column) -> Column:
    """The value ran into another field or a page's heading."""
    low = F.lower(value)
    hit = value == "/"
    for marker in [*FOREIGN_MARKERS, *FOREIGN_PROPERTY_MARKERS.get(field, [])]:
        hit = hit | F.contains(low, F.lit(marker))
    return hit


def measured(raw: Column, units: str) -> Column:
    """A measure in reading order: ``18 mmHg @ 30°C`` or ``1.19 kg/l (20°C / 4°C)``, from columns or as it stands.

    Columns: unit (in brackets or not), condition, number. Else a number with its unit begins the text, perhaps with a
    condition in brackets. Null where neither does.
    """
    columns = rf"(?iU)^\s*:?\s*\(?\s*({units})\s*\)?\s*(?:{_AT}|{_BOTH})?\s*({_NUMBER})"
    close = lambda x: F.regexp_replace(x, r"\s+", "")
    condition = F.coalesce(F.concat(F.lit(" @ "), first(raw, columns, 2)), F.concat(F.lit(" ("), first(raw, columns, 3), F.lit(")")), F.lit(""))
    turned = F.concat(close(first(raw, columns, 4)), F.lit(" "), close(first(raw, columns, 1)), condition)
    return F.coalesce(turned, collapsed(first(raw, rf"(?iU)^\s*:?\s*({_NUMBER}\s*(?:{units})(?:\s*\([^)]{{1,40}}\))?)")))


def temperature(raw: Column, with_pressure: bool) -> Column:
    """The first number that is no pressure, no percentage or near one, in degrees, with the pressure it holds at."""
    text = F.regexp_replace(F.regexp_replace(raw, r"^\s*\([^)]*\)", ""), r"-\s+(?=\d)", "-")
    value = F.regexp_replace(first(text, rf"(?i)(?<!%.{{0,{NEAR_PERCENT}}})(?<![\d.,])([<>≤≥~]?\s*-?\d++(?:[.,]\d++)?+)(?!\s*mmHg)"), r"\s+", "")
    at = F.coalesce(F.concat(F.lit(" ("), first(text, r"(?i)(\d+(?:[.,]\d+)?\s*mmHg)\b"), F.lit(")")), F.lit("")) if with_pressure else F.lit("")
    return F.concat(value, F.lit(" °C"), at)


def rejoined(ahead: Column, raw: Column) -> Column:
    """A sentence that a table split around its label: the open end of the text before it and the first sentence after."""
    open_end = F.regexp_replace(F.regexp_extract(ahead, r"([^.!?]*)$", 1), rf"(?iU)^.*{_any(NO_VALUE_NOTES)}", "")
    whole = collapsed(F.concat(open_end, F.lit(" "), F.nullif(F.regexp_extract(raw, r"^\s*([^.!?]+[.!?])", 1), F.lit(""))))
    return F.when((F.length(F.trim(open_end)) >= SPLIT_SENTENCE) & (F.length(whole) >= SPLIT_SENTENCE), whole)


def with_properties(df: DataFrame, section: str, name: str = "properties") -> DataFrame:
    """``df`` with a struct of the sixteen properties found in the column ``section`` (null or empty: all null).

    The first label of a property with a value gives it. A measure in reading order goes before the plain value;
    temperatures and pH are read from the text after their label where the value is missing or ran into another
    field; a split sentence is joined where explosive properties say less than it does; limits that share a label are
    parted. Other columns stay as they are.
    """
    pairs, plain, done = unused(df, 3)
    out = df.withColumn(pairs, labelled(flat(F.col(section))))
    nth = lambda condition, part: F.try_element_at(F.filter(pairs, condition), F.lit(1))[part]
    named = lambda field: (lambda p: F.coalesce(p["field"] == field, F.lit(False)))

    def value(field: str) -> Column:
        found = nth(lambda p: named(field)(p) & p["value"].isNotNull(), "value")
        echo = PROPERTY_ECHOES.get(field)
        return F.nullif(F.trim(F.regexp_replace(found, rf"(?iU)^/?\s*(?:{echo})\s*:?\s*", "")), F.lit("")) if echo else found

    out = out.withColumn(plain, F.struct(*[value(f).alias(f) for f in PROPERTY_LABELS]))
    got = {f: F.col(f"{plain}.{f}") for f in PROPERTY_LABELS}
    raw = lambda field: nth(named(field), "raw")
    where_missing = lambda f, new: F.when(got[f].isNull() | is_foreign(f, got[f]), F.coalesce(new, got[f])).otherwise(got[f])
    both = nth(lambda p: p["label"].rlike(r"(?iU)^(?:Lower\s+and\s+upper|Upper\s+and\s+lower)"), "raw")
    split = rejoined(nth(named("explosive_properties"), "ahead"), raw("explosive_properties"))
    short = got["explosive_properties"].isNull() | is_foreign("explosive_properties", got["explosive_properties"]) | (F.length(got["explosive_properties"]) < SPLIT_SENTENCE)
    again = {
        "ph": where_missing("ph", F.regexp_replace(first(raw("ph"), r"^\s*:?\s*(~?\s*[<>]?\s*\d{1,2}(?:[.,]\d+)?)"), r"\s+", "")),
        "melting_freezing_point": where_missing("melting_freezing_point", temperature(raw("melting_freezing_point"), False)),
        "boiling_point": where_missing("boiling_point", temperature(raw("boiling_point"), True)),
        "vapour_pressure": F.coalesce(measured(raw("vapour_pressure"), PRESSURE_UNITS), got["vapour_pressure"]),
        "density": F.coalesce(measured(raw("density"), DENSITY_UNITS), got["density"]),
        "viscosity": F.coalesce(measured(raw("viscosity"), VISCOSITY_UNITS), got["viscosity"]),
        "explosive_properties": F.when(short, F.coalesce(split, got["explosive_properties"])).otherwise(got["explosive_properties"]),
        "lower_explosion_limit": F.coalesce(first(both, r"(?iU)\bLower\s*:?\s*([^.;]+)"), got["lower_explosion_limit"]),
        "upper_explosion_limit": F.coalesce(first(both, r"(?iU)\bUpper\s*:?\s*([^.;]+)"), got["upper_explosion_limit"]),
    }
    out = out.withColumn(done, F.transform(F.array(*[again.get(f, got[f]) for f in PROPERTY_LABELS]), tidy_value))
    return out.withColumn(name, F.struct(*[F.col(done)[i].alias(f) for i, f in enumerate(PROPERTY_LABELS)])).drop(pairs, plain, done)
