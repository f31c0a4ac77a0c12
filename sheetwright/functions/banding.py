"""Control banding: hazard groups, amounts, exposure and the control matrix as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwright.functions.lexicon import (
    AMOUNT_UNITS,
    CONTROL_APPROACHES,
    CONTROL_MATRIX,
    DUST_ADVICE,
    DUSTINESS,
    HAZARD_GROUPS,
    LIQUID,
    NO_CONTROLS_ADVICE,
    RECOMMENDATIONS,
    REFUSALS,
    SKIN_EYE,
    SKIN_EYE_ADVICE,
    SOLID,
    SOLID_FORM,
)
from sheetwright.functions.text import lower_tr, unused


def _array(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def _banded(value: Column, bands: dict[str, list[str]]) -> Column:
    out = F.lit(None).cast("string")
    for band, words in bands.items():
        out = F.when(value.isin(words), band).otherwise(out)
    return out


def code_list(codes: Column) -> Column:
    """Codes trimmed, in upper case and without white space; empty ones dropped, distinct."""
    tidy = F.transform(F.coalesce(codes, F.array().cast("array<string>")), lambda c: F.upper(F.regexp_replace(F.trim(c), r"\s+", "")))
    return F.array_distinct(F.filter(tidy, lambda c: c != ""))


def hazard_group(codes: Column) -> Column:
    """struct(grp, matched): the worst group that a code lies in (E first) and its codes in input order."""
    tidy, out = code_list(codes), F.struct(F.lit(None).cast("string").alias("grp"), F.array().cast("array<string>").alias("matched"))
    for group, members in HAZARD_GROUPS.items():  # A first, so that E ends outermost
        hit = F.array_intersect(tidy, _array(members))
        out = F.when(F.size(hit) > 0, F.struct(F.lit(group).alias("grp"), hit.alias("matched"))).otherwise(out)
    return out


def worst_group(tidy: Column) -> Column:
    """The worst group that one of the tidy codes lies in, E first."""
    worst = {code: group for group, members in HAZARD_GROUPS.items() for code in members}  # A first: worse ones stay
    groups = F.create_map(*[F.lit(x) for pair in worst.items() for x in pair])
    return F.array_max(F.transform(tidy, lambda c: F.try_element_at(groups, c)))


def skin_eye_codes(codes: Column) -> Column:
    return F.filter(code_list(codes), lambda c: c.isin(SKIN_EYE))


def amount_band(value: Column, unit: Column) -> Column:
    """Small, Medium or Large by the unit; null unless the amount is a positive number."""
    number = F.trim(value.cast("string")).try_cast("double")
    good = (number > 0) & (number < float("inf"))
    return F.when(good, _banded(F.lower(F.trim(unit)), AMOUNT_UNITS))


def dustiness(value: Column) -> Column:
    return _banded(lower_tr(F.trim(value)), DUSTINESS)


def numeric_value(value: Column) -> Column:
    """The first signed decimal of a text, its first comma read as a point."""
    text = F.regexp_replace(value.cast("string"), r"(?s)^([^,]*),", "$1.")
    number = F.regexp_extract(text, r"(-?\d+(?:\.\d+)?)", 1)
    return F.when(number != "", number.try_cast("double"))


def volatility(boiling: Column, process: Column) -> Column:
    """struct(band, status) of a liquid by its boiling point and the process temperature (25 unless given)."""
    bp, pt = numeric_value(boiling), F.coalesce(numeric_value(process), F.lit(25.0))
    band = F.when(bp <= 20, None).when(bp <= 2 * pt + 10, "High").when(bp >= 5 * pt + 50, "Low").when(bp.isNotNull(), "Medium")
    status = F.when(bp.isNull(), "needs_review").when(bp <= 20, "special_case").otherwise("calculated")
    return F.struct(band.alias("band"), status.alias("status"))


def is_solid(form: Column) -> Column:
    return F.coalesce(lower_tr(F.trim(form)).isin(SOLID), F.lit(False))


def is_liquid(form: Column) -> Column:
    return F.coalesce(lower_tr(F.trim(form)).isin(LIQUID), F.lit(False))


def matrix_number(group: Column, amount: Column, column: Column) -> Column:
    """The matrix entry, a lookup in a literal map of its 60 cells."""
    cells = [(f"{g}|{a}|{e}", n) for g, amounts in CONTROL_MATRIX.items() for a, row in amounts.items() for e, n in row.items()]
    table = F.create_map(*[F.lit(x) for cell in cells for x in cell])
    return F.try_element_at(table, F.concat_ws("|", group, amount, column))


def approach(number: Column, field: int) -> Column:
    """The title (0) or sheet (1) of a control approach."""
    return F.try_element_at(F.create_map(*[F.lit(x) for n, texts in CONTROL_APPROACHES.items() for x in (n, texts[field])]), number)


def recommendations(number: Column, skin_eye: Column, existing: Column, form: Column) -> Column:
    none = F.array().cast("array<string>")
    parts = [F.when(number == n, _array(texts)).otherwise(none) for n, texts in RECOMMENDATIONS.items()]
    parts.append(F.when(skin_eye, _array(SKIN_EYE_ADVICE)).otherwise(none))
    parts.append(F.when(F.trim(F.coalesce(existing, F.lit(""))) == "", _array([NO_CONTROLS_ADVICE])).otherwise(none))
    parts.append(F.when(lower_tr(F.coalesce(form, F.lit(""))).isin("katı", "kati"), _array([DUST_ADVICE])).otherwise(none))
    return F.array_distinct(F.flatten(F.array(*parts)))


def with_assessment(df: DataFrame, codes: Column, amount: Column, unit: Column, form: Column, dust: Column, boiling: Column, process: Column, existing: Column, name: str = "assessment") -> DataFrame:
    """``df`` with the whole assessment of one use of a chemical as a struct.

    What several parts of it read is computed in columns of its own first, since the optimizer writes an expression out
    wherever it is used.
    """
    names = unused(df, 9)
    tidy, size, solid, liquid, high, grp, exposure, number, status = map(F.col, names)
    steps = df.withColumns(dict(zip(names[:4], (code_list(codes), amount_band(amount, unit), is_solid(form), is_liquid(form)), strict=True)))
    steps = steps.withColumns({names[4]: volatility(boiling, process)["band"], names[5]: worst_group(tidy)})
    steps = steps.withColumn(names[6], F.when(solid, dustiness(dust)).when(liquid, high))
    column = F.when(exposure != "Medium", exposure).otherwise(F.when(solid, "MediumSolid").otherwise("MediumLiquid"))
    missing = grp.isNull() | size.isNull() | (F.coalesce(form, F.lit("")) == "") | exposure.isNull()
    steps = steps.withColumn(names[7], F.when(missing, None).when(~solid & ~liquid, 4).otherwise(matrix_number(grp, size, column)).cast("int"))
    steps = steps.withColumn(names[8], F.when(missing | number.isNull(), "needs_review").when(~solid & ~liquid, "special_case").otherwise("calculated"))
    members = F.create_map(*[F.lit(x) if isinstance(x, str) else _array(x) for pair in HAZARD_GROUPS.items() for x in pair])
    matched = F.coalesce(F.array_intersect(tidy, F.try_element_at(members, grp)), F.array().cast("array<string>"))
    skin = F.filter(tidy, lambda c: c.isin(SKIN_EYE))
    found = F.struct(
        grp.alias("hazard_group"),
        matched.alias("matched_codes"),
        (F.size(skin) > 0).alias("skin_eye"),
        size.alias("amount_band"),
        exposure.alias("exposure_band"),
        number.alias("control_number"),
        status.alias("control_status"),
        approach(number, 1).alias("sheet"),
        recommendations(number, F.size(skin) > 0, existing, form).alias("recommendations"),
        ((status != "calculated") | grp.isNull() | (grp == "E") | size.isNull() | exposure.isNull()).alias("needs_review"),
    )
    return steps.withColumn(name, found).drop(*names)


def refusal(chosen: Column, current: Column, process: Column, amount: Column, form: Column, dust: Column) -> Column:
    """Why a use can't be assessed, the first of six reasons; null where it can.

    ``chosen`` and ``current`` are the ids of the chemical and its current document. A process of blanks counts as
    missing; solids need a dustiness.
    """
    missing = lambda c: F.coalesce(c.cast("string"), F.lit("")) == ""
    rules = [chosen.isNull(), current.isNull(), missing(F.trim(process)), missing(amount), missing(form), (form == SOLID_FORM) & missing(dust)]
    out = F.lit(None).cast("string")
    for rule, text in reversed(list(zip(rules, REFUSALS, strict=True))):
        out = F.when(rule, text).otherwise(out)
    return out
