"""From text to facts: one wide row of typed columns for each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwright.functions import codes, dates, identity
from sheetwright.functions.handling import with_handling
from sheetwright.functions.properties import with_properties
from sheetwright.functions.protection import with_protection
from sheetwright.functions.text import collapsed, is_suspicious_name, normalised, unused
from sheetwright.operators.sections import classification_status, confidence, document_type, split_sections, upper_text

PHYSICAL_FORMS = {"Sıvı": ["sıvı", "liquid"], "Katı": ["katı", "toz", "solid"], "Gaz": ["gaz", "buhar", "gas"]}


def physical_form(state: Column) -> Column:
    """Sıvı, Katı or Gaz: the first whose words occur in a state."""
    low = F.lower(F.translate(F.coalesce(state, F.lit("")), "Iİ", "ıi"))
    out = F.lit(None).cast("string")
    for form, words in reversed(PHYSICAL_FORMS.items()):
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(low, F.lit(word))
        out = F.when(hit, form).otherwise(out)
    return out


def document_facts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the facts of each sheet. Product identifiers come from section 1, components from 3, hazards from 2.

    The text is normalised first, as everything reads it. The facts' own columns (``sections``, ``product_name`` and so
    on) replace columns of the same name; all others stay.
    """
    clean, parts, upper = unused(docs, 3)
    whole = F.col(clean)
    split = split_sections(docs.withColumn(clean, normalised(F.col(text))), clean)
    # Each section is looked up once; facts then read narrow columns.
    split = split.withColumn(upper, upper_text(whole)).withColumn(parts, F.struct(*[F.try_element_at("sections", F.lit(n)).alias(f"s{n}") for n in (1, 2, 3, 9)]))
    s = {n: F.col(f"{parts}.s{n}") for n in (1, 2, 3, 9)}
    split = dates.with_dates(identity.with_manufacturer(split, s[1], whole), whole)
    line = lambda n, label: collapsed(codes.first(s[n], rf"(?imU)^\s*(?:{label})\s*:\s*([^\n]+)"))
    facts = split.withColumns(
        {
            "document_type": document_type(whole, F.col(upper)),
            "product_name": identity.product_name(s[1], whole),
            "product_code": codes.product_code(s[1]),
            "ufi": F.array_join(codes.ufis(s[1]), "; "),
            "product_cas": codes.cas_numbers(s[1]),
            "product_ec": codes.ec_number(s[1]),
            "product_reach": F.try_element_at(codes.reach_numbers(s[1]), F.lit(1)),
            "component_cas": codes.cas_numbers(s[3]),
            "component_names": codes.component_names(s[3]),
            "component_reach": codes.reach_numbers(s[3]),
            "component_ec": codes.ec_number(s[3]),
            "component_ecs": codes.ec_numbers(s[3]),
            "hazard_codes": codes.hazard_codes(s[2]),
            "precautionary_codes": codes.precautionary_codes(s[2]),
            "signal_word": codes.signal_word(s[2]),
            "explicit_ghs": codes.pictograms(s[2]),
            "physical_state": line(9, "State|Physical state|Fiziksel hal"),
            "boiling_point": line(9, "Boiling point|Kaynama noktası"),
            "sds_confidence": confidence(whole, F.col("sections"), F.col(upper)),
        }
    )
    status = classification_status(s[2], F.size("hazard_codes") > 0, F.size("precautionary_codes") > 0, F.col("signal_word").isNotNull(), F.size("explicit_ghs") > 0)
    facts = facts.withColumn("classification_status", status)
    ghs = F.when(F.col("classification_status") == "classified", F.array_union("explicit_ghs", codes.implied_pictograms(F.col("hazard_codes")))).otherwise(F.col("explicit_ghs"))
    facts = facts.withColumn("ghs_codes", ghs)
    return facts.withColumn("review_reasons", review_reasons()).withColumn("processing_status", processing_status()).drop(clean, parts, upper)


def with_details(facts: DataFrame) -> DataFrame:
    """``facts`` with ``handling`` (section 7), ``protection`` (section 8) and ``properties`` (section 9) as structs."""
    names = unused(facts, 3)
    out = facts.withColumns({c: F.try_element_at("sections", F.lit(n)) for c, n in zip(names, (7, 8, 9), strict=True)})
    for read, column in zip((with_handling, with_protection, with_properties), names, strict=True):
        out = read(out, column)
    return out.drop(*names)


def backfill_profile(facts: DataFrame) -> DataFrame:
    """What a backfill compares: identifiers of section 1, or of section 3 where it has none; lists sorted and distinct."""
    listed = lambda c: F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")))
    tidy = lambda c: F.nullif(F.trim(c), F.lit(""))
    cas = F.when(F.size("product_cas") > 0, F.col("product_cas")).otherwise(F.col("component_cas"))
    return facts.withColumns(
        {
            "cas_numbers": listed(cas),
            "ec_number": tidy(F.coalesce("product_ec", "component_ec")),
            "reach_number": tidy(F.coalesce("product_reach", F.try_element_at("component_reach", F.lit(1)))),
            "ufi": tidy(F.col("ufi")),
            "product_code": tidy(F.col("product_code")),
            "signal_word": tidy(F.col("signal_word")),
            **{c: listed(F.col(c)) for c in ("hazard_codes", "precautionary_codes", "ghs_codes")},
        }
    )


def review_reasons() -> Column:
    """Why a document needs a look, in a fixed order."""
    has = lambda n: F.map_contains_key("sections", F.lit(n))
    ids = (F.size("product_cas") > 0) | F.col("component_ec").isNotNull() | (F.col("ufi") != "") | F.col("product_code").isNotNull()
    rules = [
        (F.col("product_name").isNull(), "product_name_needs_review"),
        (is_suspicious_name(F.col("manufacturer")), "manufacturer_needs_review"),
        (~ids, "chemical_identifier_missing"),
        (F.size("sections") < 10, "low_section_count"),
        (F.col("sds_confidence") < 0.60, "low_sds_confidence"),
        (has(2) & (F.col("classification_status") == "unknown"), "classification_status_unknown"),
        (has(2) & (F.col("classification_status") == "classified") & (F.size("hazard_codes") == 0) & F.col("signal_word").isNull() & (F.size("ghs_codes") == 0), "section_2_data_incomplete"),
    ]
    return F.array_compact(F.array(*[F.when(rule, F.lit(reason)) for rule, reason in rules]))


def processing_status(enough: int = 14) -> Column:
    """needs_review before sections_extracted before sections_incomplete."""
    return F.when(F.size("review_reasons") > 0, "needs_review").when(F.size("sections") >= enough, "sections_extracted").otherwise("sections_incomplete")
