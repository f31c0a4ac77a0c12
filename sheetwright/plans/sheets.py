"""Queries of sections 7 to 9, structure, layout, child tables and display over sheets made from keys, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwright.functions import codes, layout, lexicon_sections as lex, text
from sheetwright.functions.handling import with_handling
from sheetwright.functions.properties import with_properties
from sheetwright.functions.protection import LISTS, with_protection
from sheetwright.functions.structure import structured
from sheetwright.operators import relational, reports
from sheetwright.operators.answers import golden, parsed_answers
from sheetwright.operators.facts import backfill_profile, document_facts, with_details
from sheetwright.operators.sections import section_rows, split_sections
from sheetwright.operators.store import DOCUMENT, child_arrays, differences
from sheetwright.plans.extraction import CAS_SQL
from sheetwright.plans.views import dealt, table
from sheetwright.sources.render import HAZARDS, TITLES, rendered


def _pick(labels: list[str], by: str = "k") -> str:
    """SQL for the label that a key picks."""
    return "array(" + ", ".join(f"'{w}'" for w in labels) + f")[int({by} % {len(labels)})]"


def _keyed(spark: SparkSession, d: str, value: str, name: str = "value") -> DataFrame:
    keys = dealt(table(spark, d, "part").selectExpr("p_partkey as k"), "k")
    return keys.selectExpr("k as p_partkey", f"{value} as {name}")


_SEVEN = f"""if(k % 5 = 0, concat('7.1 Precautions for safe handling\\nHandle item ', k, ' with all due care.\\n'),
    concat('7.1 ', {_pick(lex.HANDLING)}, ': Avoid contact with item ', k, ' at all times.\\n', {_pick(lex.FIRE)}, ': Keep item ', k, ' away from heat.\\n--- PAGE 4 ---\\n'))
    || concat('7.2. ', {_pick(lex.STORAGE)}, ': Store item ', k, ' in a dry room.\\n', {_pick(lex.INCOMPATIBLE)}, ' - Acids and item ', k + 1, ' mixed, see 7.1\\n7.3 ', {_pick(lex.END_USE)}, ': Only use as item ', k, ' intends.')"""


def _handling(spark: SparkSession, d: str) -> DataFrame:
    joined = lambda c: F.array_join(f"handling.{c}", "|").alias(c)
    found = with_handling(_keyed(spark, d, _SEVEN), "value")
    return found.select("p_partkey", *[joined(c) for c in ("handling_precautions", "storage_conditions", "incompatible_materials", "fire_explosion_precautions")], "handling.specific_end_use", F.length("handling.raw_subsection_7_3").alias("raw_3"))


_EIGHT = (
    "concat('SECTION 8\\n8.1 Control parameters\\nTWA ', k % 50 + 1, ' ppm for item ', k, ' in air\\nKaynak TWA STEL\\nDNEL of item ', k, ': 5 mg/kg\\nPNEC of item ', k, ': 1 mg/l\\n8.2 Exposure controls\\n', "
    f"if(k % 4 = 0, concat('Good ventilation of room ', k, '. Provide a shower.\\n'), concat('8.2.1 ', {_pick(lex.PROTECTION['engineering_controls'])}, ': Ventilate room ', k, '.\\n')), "
    f"'8.2.2.1. ', {_pick(lex.PROTECTION['respiratory_protection'])}, ' Wear mask ', k, '.\\n', {_pick(lex.PROTECTION['hand_protection'])}, ': Use nitrile gloves ≥ 0,', k % 9 + 1, ' mm. Change them daily.\\n', "
    f"{_pick(lex.PROTECTION['eye_face_protection'])}, ': Wear goggles ', k, '.\\n', {_pick(lex.PROTECTION['body_protection'])}, ': Wear coat ', k, '.\\n', "
    f"if(k % 3 = 0, concat('{lex.PROTECTION['environmental_controls'][-1]}: none.\\nPlease wash hands after shift ', k), concat({_pick(lex.PROTECTION['hygiene_measures'])}, ': Wash hands after shift ', k, '.')))"
)


def _protection(spark: SparkSession, d: str) -> DataFrame:
    return with_protection(_keyed(spark, d, _EIGHT), "value").select("p_partkey", *[F.array_join(f"protection.{c}", "|").alias(c) for c in LISTS])


_NINE = (
    "concat('Physical state: liquid\\nColour: c', k, '\\nOdour threshold: n/a\\nOdour: mild\\npH: ', k % 14, '\\nMelting point: -', k % 50, ' °C\\nBoiling point: ', k % 300, ' °C\\nFlash point: ', k % 90, ' °C\\n', "
    "if(k % 2 = 0, concat('Vapour pressure: ', k % 30, ' hPa (20°C)\\nDensity: 1.', k % 9, ' g/cm3\\nViscosity: ', k % 20, ' mPa s\\n'), "
    "concat('Buhar basıncı (mmHg) @ 30°C ', k % 30, ' Bağıl yoğunluk kg/l 20°C / 4°C 1.', k % 9, ' Viskozite cps @25°C ', k % 20, '\\n')), "
    "'Solubility in water: soluble ', k, '\\nFlammability: class ', k % 4, '\\nExplosive properties: not explosive at all ', k, '\\nOxidizing properties: none seen ', k, "
    "if(k % 3 = 0, concat('\\nLower and upper explosion limits Lower: ', k % 5, ' vol%; Upper: ', k % 5 + 9, ' vol%'), concat('\\nLower explosion limit: ', k % 5, ' vol%\\nUpper flammability limit: ', k % 5 + 9, ' vol%')))"
)


def _recovered(spark: SparkSession, d: str) -> DataFrame:
    """Sheets whose fifth heading stands only as 5.1, for odd keys after a reference to it."""
    turned = F.regexp_replace("text", "SECTION 5: [^\n]*\n", "see 5.2 and 15.1 below\n5.1 Firefighting measures by kind\n")
    return section_rows(split_sections(rendered(spark, d).withColumn("text", turned))).where("section_number between 4 and 6").select("doc_id", "section_number", F.sha2("content", 256).alias("digest"))


_LOOSE = "concat('SAFETY  DATA SHEET SECTION 1: Identification Product name Item ', k, '\\tSupplier: Maker ', k, ' Signal wordWarning 2.1. Label elements H ', 300 + k % 9, ' P305 + 351 + P338 renksiz kokusuz DNELs tripolyphosphate --- PAGE 2 --- Renk: beyaz see section 7 koku: suz')"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    value = "array('1.1 Product name', concat('Item ', k), 'Fiziksel Hal :', 'Renk :', 'Koku :', 'Yoğunluk :', 'sıvı', concat('c', k), '-', 'solvent', concat('0,', k), 'Flash point: ', 'Viscosity  ', concat(k % 70, ' mPas'), concat('pH ', k % 14))"
    return _keyed(spark, d, value, "lines")


def _labels(spark: SparkSession, d: str) -> DataFrame:
    every = [a for names in lex.PROPERTY_NAMES.values() for a in names]
    lines = F.col("lines")
    return _lines(spark, d).select(
        "p_partkey",
        layout.field_value(lines, ["Product name"]).alias("name"),
        layout.field_value(lines, ["ph", "ph value"], every).alias("ph"),
        layout.field_value(lines, ["flash point"], every).alias("flash"),
        layout.field_value(lines, ["viscosity"], every).alias("viscosity"),
        layout.is_label(F.element_at(lines, 1), ["PRODUCT NAME"]).alias("is_label"),
        F.array_join(layout.block(F.array_join(lines, "\n"), ["koku"], ["viscosity"], (r"0,\d",)), "|").alias("block"),
    )


def _columns(spark: SparkSession, d: str) -> DataFrame:
    found = layout.column_values(F.col("lines"), lex.PROPERTY_NAMES)
    # The outer form keeps the optimizer from adding a filter on the map, which would make the map again.
    return _lines(spark, d).select("p_partkey", found.alias("m")).select("p_partkey", F.explode_outer("m").alias("field", "value")).where("field is not null")


def _children(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the child tables, documents and chemicals that an upload of the sheets makes: child, doc_id, value.

    Values are joined; of sections the heading is taken, of documents what the key decides.
    """
    sheets = rendered(spark, d)
    for old, new in (("Keep closed.", "concat('7.2 Storage conditions: Keep item ', doc_id, ' in a dry room.')"), ("General text of part 8.", "concat('Hand protection: Wear nitrile gloves of 0,', doc_id % 9 + 1, ' mm.')"), ("\nState: ", "'\\nPhysical state: '")):
        sheets = sheets.withColumn("text", F.expr(f"if(doc_id % 2 = 1, replace(text, '{old.replace(chr(10), chr(92) + 'n')}', {new}), text)"))
    parsed = with_details(document_facts(sheets))
    arrays = child_arrays()
    arrays["sections"] = F.transform(arrays["sections"], lambda x: F.struct(x["section_number"], F.substring_index(x["content"], "\n", 1)))
    arrays["documents"] = F.array(F.struct(*[c for c in DOCUMENT if c not in ("doc_id", "file_hash", "chemical_id")], F.size("sections").alias("section_count")))
    arrays["chemicals"] = F.array(F.struct("product_name", "manufacturer", "product_code"))
    flat = {"identifiers", "sections", "hazard_codes", "precautionary_codes", "ghs_codes", "chemicals"}

    def rows(name: str) -> Column:
        value = lambda x: F.to_csv(x, {"sep": "|", "emptyValue": ""}) if name in flat else F.to_json(x)
        return F.transform(arrays[name], lambda x: F.struct(F.lit(name).alias("child"), value(x).alias("value")))

    every = F.flatten(F.array_compact(F.array(*map(rows, arrays))))
    return parsed.select("doc_id", F.explode_outer(every).alias("r")).where("r is not null").select("r.child", "doc_id", "r.value")


def _preview(spark: SparkSession, d: str) -> DataFrame:
    facts = document_facts(rendered(spark, d))
    stored = table(spark, d, "part").where("p_partkey % 10 <> 0").selectExpr(
        "p_partkey as doc_id", "'h' as file_hash", "if(p_partkey % 3 = 0, 'Old name', p_name) as product_name", "if(p_partkey % 13 = 0, null, concat(p_brand, ' Chemicals')) as manufacturer", "concat('BK', p_partkey) as product_code",
        "if(p_partkey % 7 = 0, 'AAAA-MN1G-R608-0000', concat('V873-MN1G-R608-', lpad(p_partkey % 10000, 4, '0'))) as ufi", "if(p_partkey % 2 = 0, 'Danger', 'Warning') as signal_word", "date_add(date'2015-01-01', int(p_partkey % 3000)) as revision_date",
        "cast(null as date) as preparation_date", "concat(p_partkey % 9 + 1, '.', p_partkey % 5) as version", "if(p_partkey % 13 = 0, 'needs_review', 'sections_extracted') as processing_status",
    )
    return differences(facts, stored)


def _profile(spark: SparkSession, d: str) -> DataFrame:
    profile = backfill_profile(document_facts(rendered(spark, d)))
    return profile.select("doc_id", F.array_join("cas_numbers", "|").alias("cas"), "ec_number", "reach_number", F.array_join("hazard_codes", "|").alias("codes"))


def _display(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, None).when(k == 1, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    at = F.when(k == 0, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'10:30:00"))
    return table(spark, d, "orders").select("o_orderkey", reports.display_date(raw).alias("day"), reports.display_time(at).alias("time"))


def _identifiers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey as chemical_id", "l_linenumber * 10000000 + l_partkey as id", "if(l_linenumber % 2 = 0, 'cas', ' EC ') as identifier_type", "if(l_partkey % 5 = 0, ' ', concat('N', l_partkey)) as identifier_value")
    return relational.identifier_of(rows, "CAS")


def _golden(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("record")
    found = golden(rendered(spark, d))
    return found.select("doc_id", F.to_json(F.struct(r["section_count"].alias("sections"), r["section_1"].alias("s1"), r["section_2"].alias("s2"), r["section_3"].alias("s3"), r["revision"].alias("revision"), r["ingestion_summary"].alias("summary"))).alias("record"))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    parsed = with_details(document_facts(rendered(spark, d)))
    return parsed_answers(parsed, ["product_name", "manufacturer", "signal_word"]).select("doc_id", F.to_json(answer_head(F.col("answer"))).alias("answer"))


def answer_head(answer: Column) -> Column:
    """An answer with its sections' numbers in place of their texts."""
    return F.struct(*[answer[c].alias(c) for c in ("document", "hazard_codes", "precautionary_codes", "ghs_codes", "identifiers", "physical_properties", "section_count")], F.transform(answer["sections"], lambda s: s["section_number"]).alias("numbers"))


_NUMBERS = "concat(if(k % 4 = 0, '', concat('EINECS No: 1', lpad(k % 100, 2, '0'), '-000-1 ')), 'EC-No.: 200-', lpad(k % 1000, 3, '0'), '-2 EG numarası 300-300-', k % 10, ' EC 400-400-4, EC: 400-400-4 Article No: A', k, if(k % 3 = 0, concat(' Product code(s) P', k), ''), if(k % 5 = 0, concat(' Ürün Kodu ( ları ) : T/', k), ''))"

QUERIES = {
    "ec_numbers_all": lambda s, d: _keyed(s, d, _NUMBERS).select("p_partkey", F.array_join(codes.ec_numbers(F.col("value")), "|").alias("numbers")),
    "product_code_labels": lambda s, d: _keyed(s, d, _NUMBERS).select("p_partkey", codes.product_code(F.col("value")).alias("code")),
    "identifier_lists": lambda s, d: relational.identifiers_of(table(s, d, "lineitem").selectExpr("l_orderkey as chemical_id", "if(l_linenumber % 2 = 0, 'CAS', 'cas') as identifier_type", "if(l_partkey % 5 = 0, ' ', concat(' N', l_partkey % 50)) as identifier_value"), "CAS").select("chemical_id", F.array_join("values", "|").alias("found")),
    "preview_texts": lambda s, d: table(s, d, "documents").select("doc_id", F.sha2(text.preview(F.col("text")), 256).alias("digest")),
    "value_lists": lambda s, d: _keyed(s, d, "if(k % 7 = 0, null, array('a', '', null, concat('v', k % 9), 'a', ' '))").select("p_partkey", F.array_join(text.value_list(F.col("value")), "|").alias("kept")),
    "sheet_golden": _golden,
    "sheet_answers": _answers,
    "s7_handling": _handling,
    "s8_protection": _protection,
    "s9_all_properties": lambda s, d: with_properties(_keyed(s, d, _NINE), "value").select("p_partkey", "properties.*"),
    "sections_recovered": _recovered,
    "structure_normalise": lambda s, d: _keyed(s, d, _LOOSE).select("p_partkey", structured(F.col("value")).alias("value")),
    "label_values": _labels,
    "column_values": _columns,
    "meaningful_values": lambda s, d: _keyed(s, d, "array('a', '-', null, concat(' b  ', k), if(k % 2 = 0, '..', 'c'))").select("p_partkey", F.array_join(layout.meaningful(F.col("value")), "|").alias("kept"), layout.count_meaningful(F.col("value")).alias("n"), (~text.is_placeholder(F.element_at("value", 5))).alias("last")),
    "no_data_values": lambda s, d: _keyed(s, d, "array('Bilgi  yok.', 'Veri var', 'Not applicable here', null)[int(k % 4)]").select("p_partkey", text.says_no_data(F.col("value")).alias("no_data"), text.is_suspicious_name(F.col("value")).alias("suspicious")),
    "child_tables": _children,
    "reprocess_preview": _preview,
    "backfill_profile": _profile,
    "display_dates": _display,
    "identifier_of": _identifiers,
    "code_lists": lambda s, d: relational.code_lists(table(s, d, "lineitem").selectExpr("l_orderkey as doc_id", "if(l_partkey % 9 = 0, ' ', concat(' H', l_partkey % 30)) as code"), "doc_id", "code").select("doc_id", F.array_join("values", "|").alias("codes")),
}

_K = "k AS (SELECT p_partkey AS k, p_name, p_brand, p_size FROM part)"
_H = f"[{', '.join(repr(x) for x in HAZARDS)}]"


def _children_sql() -> str:
    headings = [f"{n}|{'SECTION' if n % 2 else 'BÖLÜM'} {n}: {title}" for n, title in enumerate(TITLES, 1)]
    none = lambda names: ",".join(f'"{n}":[]' for n in names)
    glove = "'\"Wear nitrile gloves of 0,' || (k % 9 + 1) || ' mm.\"'"
    protection = "'{\"respiratory_protection\":[],\"hand_protection\":[' || g || '],\"glove_materials\":[' || g || '],\"glove_thickness\":[' || t || '],' || '" + none(LISTS[LISTS.index("glove_thickness") + 1 :]) + "}'"
    return f"""WITH {_K}, f AS (SELECT *, k % 2 = 1 AS odd, {CAS_SQL} AS cas, 'V873-MN1G-R608-' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0') AS ufi, k % 13 <> 0 AS named FROM k)
        SELECT 'chemicals' AS child, k AS doc_id, p_name || '|' || CASE WHEN named THEN p_brand || ' Chemicals' ELSE '' END || '|BK' || k AS value FROM f
        UNION ALL SELECT 'documents', k, '{{"document_type":"SDS","product_name":"' || p_name || '",' || CASE WHEN named THEN '"manufacturer":"' || p_brand || ' Chemicals",' ELSE '' END || '"product_code":"BK' || k || '","ufi":"' || ufi
            || '","signal_word":"' || CASE WHEN k % 2 = 0 THEN 'Danger' ELSE 'Warning' END || '","revision_date":"' || CAST(CAST(DATE '2015-01-01' + CAST(k % 3000 AS INTEGER) AS DATE) AS VARCHAR) || '","version":"' || (k % 9 + 1) || '.' || (k % 5)
            || '","sds_confidence":' || CASE WHEN k % 11 = 0 THEN '0.85' ELSE '1.00' END || ',"classification_status":"classified","processing_status":"' || CASE WHEN named THEN 'sections_extracted' ELSE 'needs_review' END
            || '","review_reasons":[' || CASE WHEN named THEN '' ELSE '"manufacturer_needs_review"' END || '],"section_count":' || CASE WHEN k % 7 = 0 THEN 15 ELSE 16 END || '}}' FROM f
        UNION ALL SELECT 'hazard_codes', k, unnest([{_H}[k % 10 + 1], {_H}[(k + 3) % 10 + 1]]) FROM f
        UNION ALL SELECT 'precautionary_codes', k, ['P280', 'P305+P351+P338', 'P302+P352', 'P264'][k % 4 + 1] FROM f
        UNION ALL SELECT 'ghs_codes', k, unnest(list_distinct(list_filter(list_transform([{_H}[k % 10 + 1], {_H}[(k + 3) % 10 + 1]], lambda c: CASE WHEN c = 'H225' THEN 'GHS02' WHEN c IN ('H290', 'H314') THEN 'GHS05' WHEN c IN ('H315', 'H302', 'H319') THEN 'GHS07' WHEN c IN ('H351', 'H340') THEN 'GHS08' END), lambda g: g IS NOT NULL))) FROM f
        UNION ALL SELECT 'identifiers', k, unnest(list_filter(['UFI|' || ufi, CASE WHEN k % 3 <> 0 THEN 'CAS|' || cas END, 'EC|2' || lpad(CAST(k % 100 AS VARCHAR), 2, '0') || '-181-' || (k % 10),
            'REACH|01-2119' || lpad(CAST(k % 1000000 AS VARCHAR), 6, '0') || '-33-0001', 'PRODUCT_CODE|BK' || k], lambda x: x IS NOT NULL)) FROM f
        UNION ALL SELECT 'sections', k, h FROM f, (SELECT unnest({headings!r}) AS h) WHERE k % 7 <> 0 OR NOT starts_with(h, '12|')
        UNION ALL SELECT 'physical_properties', k, '{{' || CASE WHEN odd THEN '"physical_state":"' || ['Katı', 'Sıvı', 'Toz', 'Gaz'][k % 4 + 1] || '",' ELSE '' END || '"boiling_point":"' || (p_size * 10) || ' °C"}}' FROM f
        UNION ALL SELECT 'ppe_info', k, {protection} FROM (SELECT k, CASE WHEN odd THEN {glove} ELSE '' END AS g, CASE WHEN odd THEN '"0,' || (k % 9 + 1) || ' mm"' ELSE '' END AS t FROM f)
        UNION ALL SELECT 'storage_info', k, '{{"handling_precautions":[],"storage_conditions":[' || CASE WHEN odd THEN '"Keep item ' || k || ' in a dry room.' || CASE WHEN k % 5 = 0 THEN ' For disposal see Section 13 of this sheet.' ELSE '' END || '"' ELSE '' END
            || '],"incompatible_materials":[],"fire_explosion_precautions":[]}}' FROM f"""


_SHEET_SQL = f"""{_K}, f AS (SELECT *, k % 13 <> 0 AS named, 'V873-MN1G-R608-' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0') AS ufi, CASE WHEN k % 2 = 0 THEN 'Danger' ELSE 'Warning' END AS word, [{_H}[k % 10 + 1], {_H}[(k + 3) % 10 + 1]] AS h,
    '2' || lpad(CAST(k % 100 AS VARCHAR), 2, '0') || '-181-' || (k % 10) AS ec, '01-2119' || lpad(CAST(k % 1000000 AS VARCHAR), 6, '0') || '-33-0001' AS reach, CASE WHEN k % 3 <> 0 THEN {CAS_SQL} END AS cas,
    ['P280', 'P305+P351+P338', 'P302+P352', 'P264'][k % 4 + 1] AS p FROM k),
    l AS (SELECT *, list_filter(list_transform(h, lambda c: CASE WHEN c = 'H225' THEN 'GHS02' WHEN c IN ('H290', 'H314') THEN 'GHS05' WHEN c IN ('H315', 'H302', 'H319') THEN 'GHS07' WHEN c IN ('H351', 'H340') THEN 'GHS08' END), lambda x: x IS NOT NULL) AS implied FROM f),
    g AS (SELECT *, CASE WHEN len(implied) = 2 AND implied[1] = implied[2] THEN implied[1:1] ELSE implied END AS ghs0 FROM l)"""
_QUOTED = "'[' || array_to_string(list_transform({0}, lambda x: '\"' || x || '\"'), ',') || ']'"
_NAMED = """'"product_name":"' || p_name || '",' || CASE WHEN named THEN '"manufacturer":"' || p_brand || ' Chemicals",' ELSE '' END"""
ORACLE_SQL = {
    "ec_numbers_all": f"""WITH {_K} SELECT k AS p_partkey, '400-400-4|200-' || lpad(CAST(k % 1000 AS VARCHAR), 3, '0') || '-2|300-300-' || (k % 10) || CASE WHEN k % 4 = 0 THEN '' ELSE '|1' || lpad(CAST(k % 100 AS VARCHAR), 2, '0') || '-000-1' END AS numbers FROM k""",
    "product_code_labels": f"WITH {_K} SELECT k AS p_partkey, CASE WHEN k % 5 = 0 THEN 'T/' || k WHEN k % 3 = 0 THEN 'P' || k ELSE 'A' || k END AS code FROM k",
    "identifier_lists": "SELECT l_orderkey AS chemical_id, array_to_string(list_sort(list(DISTINCT 'N' || (l_partkey % 50))), '|') AS found FROM lineitem WHERE l_partkey % 5 <> 0 AND l_linenumber % 2 = 0 GROUP BY 1",
    "preview_texts": r"WITH t AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents) SELECT doc_id, sha256(CASE WHEN length(t) <= 700 THEN t ELSE left(t, 700) || chr(10) || '...[DEVAMI KESİLDİ]...' END) AS digest FROM t",
    "value_lists": f"WITH {_K} SELECT k AS p_partkey, CASE WHEN k % 7 = 0 THEN '' ELSE 'a|v' || (k % 9) || '|a| ' END AS kept FROM k",
    "sheet_golden": f"""WITH {_SHEET_SQL} SELECT k AS doc_id, '{{"sections":' || CASE WHEN k % 7 = 0 THEN 15 ELSE 16 END || ',"s1":{{' || {_NAMED} || '"cas_numbers":[],"product_code":"BK' || k || '","ufi":"' || ufi || '"}},"s2":{{"hazard_codes":' || {_QUOTED.format("h")}
        || ',"precautionary_codes":["' || p || '"],"signal_word":"' || word || '","ghs_codes":[]}},"s3":{{"cas_numbers":' || CASE WHEN cas IS NULL THEN '[]' ELSE '["' || cas || '"]' END || ',"ec_numbers":["' || ec || '"],"reach_numbers":["' || reach || '"],"component_names":["' || p_name
        || '"],"ec_number":"' || ec || '","reach_number":"' || reach || '"}},"revision":{{"revision_date":"' || CAST(CAST(DATE '2015-01-01' + CAST(k % 3000 AS INTEGER) AS DATE) AS VARCHAR) || '","version":"' || (k % 9 + 1) || '.' || (k % 5) || '"}},"summary":{{"is_probable_sds":true,"sds_confidence":'
        || CASE WHEN k % 11 = 0 THEN '0.85' ELSE '1.00' END || ',"ghs_codes":' || {_QUOTED.format("ghs0")} || ',"needs_review":' || CASE WHEN named THEN 'false' ELSE 'true' END || ',"review_reasons":' || CASE WHEN named THEN '[]' ELSE '["manufacturer_needs_review"]' END || '}}}}' AS record FROM g""",
    "sheet_answers": f"""WITH {_SHEET_SQL} SELECT k AS doc_id, '{{"document":{{' || {_NAMED} || '"signal_word":"' || word || '"}},"hazard_codes":' || {_QUOTED.format("list_sort(h)")} || ',"precautionary_codes":["' || p || '"],"ghs_codes":' || {_QUOTED.format("list_sort(ghs0)")} || ',"identifiers":['
        || CASE WHEN cas IS NULL THEN '' ELSE '{{"identifier_type":"CAS","identifier_value":"' || cas || '"}},' END || '{{"identifier_type":"EC","identifier_value":"' || ec || '"}},{{"identifier_type":"PRODUCT_CODE","identifier_value":"BK' || k || '"}},{{"identifier_type":"REACH","identifier_value":"' || reach
        || '"}},{{"identifier_type":"UFI","identifier_value":"' || ufi || '"}}],"physical_properties":{{"boiling_point":"' || (p_size * 10) || ' °C"}},"section_count":' || CASE WHEN k % 7 = 0 THEN 15 ELSE 16 END || ',"numbers":' || CASE WHEN k % 7 = 0 THEN '[1,2,3,4,5,6,7,8,9,10,11,13,14,15,16]' ELSE '[1,2,3,4,5,6,7,8,9,10,11,12,13,14,15,16]' END || '}}' AS answer FROM g""",
    "s7_handling": f"""WITH {_K} SELECT k AS p_partkey, CASE WHEN k % 5 = 0 THEN 'Handle item ' || k || ' with all due care.' ELSE 'Avoid contact with item ' || k || ' at all times.' END AS handling_precautions,
        'Store item ' || k || ' in a dry room.' AS storage_conditions, 'Acids and item ' || (k + 1) || ' mixed, see 7.1' AS incompatible_materials, CASE WHEN k % 5 = 0 THEN '' ELSE 'Keep item ' || k || ' away from heat.' END AS fire_explosion_precautions,
        'Only use as item ' || k || ' intends.' AS specific_end_use, CAST(length('7.3 ' || {str(lex.END_USE)}[k % {len(lex.END_USE)} + 1] || ': Only use as item ' || k || ' intends.') AS INTEGER) AS raw_3 FROM k""",
    "s8_protection": f"""WITH {_K} SELECT k AS p_partkey, 'Wear mask ' || k || '.' AS respiratory_protection, 'Use nitrile gloves ≥ 0,' || (k % 9 + 1) || ' mm.|Change them daily.' AS hand_protection, 'Use nitrile gloves ≥ 0,' || (k % 9 + 1) || ' mm.' AS glove_materials,
        '≥ 0,' || (k % 9 + 1) || ' mm' AS glove_thickness, 'Wear goggles ' || k || '.' AS eye_face_protection, 'Wear coat ' || k || '.' AS body_protection,
        CASE WHEN k % 4 = 0 THEN 'Good ventilation of room ' || k || '.|Provide a shower.' ELSE 'Ventilate room ' || k || '.' END AS engineering_controls, 'TWA ' || (k % 50 + 1) || ' ppm for item ' || k || ' in air' AS exposure_limits,
        'DNEL of item ' || k || ': 5 mg/kg' AS dnel, 'PNEC of item ' || k || ': 1 mg/l' AS pnec, CASE WHEN k % 3 = 0 THEN 'Please wash hands after shift ' || k ELSE 'Wash hands after shift ' || k || '.' END AS hygiene_measures FROM k""",
    "s9_all_properties": f"""WITH {_K} SELECT k AS p_partkey, 'liquid' AS physical_state, 'c' || k AS color, 'mild' AS odor, CAST(k % 14 AS VARCHAR) AS ph, '-' || (k % 50) || ' °C' AS melting_freezing_point, (k % 300) || ' °C' AS boiling_point, (k % 90) || ' °C' AS flash_point,
        CASE WHEN k % 2 = 0 THEN (k % 30) || ' hPa (20°C)' ELSE (k % 30) || ' mmHg @ 30°C' END AS vapour_pressure, CASE WHEN k % 2 = 0 THEN '1.' || (k % 9) || ' g/cm3' ELSE '1.' || (k % 9) || ' kg/l (20°C / 4°C)' END AS density,
        CASE WHEN k % 2 = 0 THEN (k % 20) || ' mPa s' ELSE (k % 20) || ' cps @ 25°C' END AS viscosity, 'soluble ' || k AS solubility, 'class ' || (k % 4) AS flammability, 'not explosive at all ' || k AS explosive_properties, 'none seen ' || k AS oxidising_properties,
        (k % 5) || ' vol%' AS lower_explosion_limit, (k % 5 + 9) || ' vol%' AS upper_explosion_limit FROM k""",
    "sections_recovered": f"""WITH {_K}, s AS (SELECT k, unnest([4, 5, 6]) AS section_number FROM k)
        SELECT k AS doc_id, section_number, sha256(CASE section_number WHEN 4 THEN 'BÖLÜM 4: {TITLES[3]}' || chr(10) || 'General text of part 4.' || chr(10) || 'see 5.2 and 15.1 below'
            WHEN 5 THEN '5.1 Firefighting measures by kind' || chr(10) || 'General text of part 5.' ELSE 'BÖLÜM 6: {TITLES[5]}' || chr(10) || 'General text of part 6.' END) AS digest FROM s""",
    "structure_normalise": f"""WITH {_K} SELECT k AS p_partkey, array_to_string(['SAFETY DATA SHEET', 'SECTION 1: Identification', 'Product name Item ' || k, 'Supplier: Maker ' || k, 'Signal word: Warning', '2.1.', 'Label elements H' || (300 + k % 9) || ' P305+P351+P338 renksiz kokusuz DNELs tripolyphosphate',
        '--- PAGE 2 ---', 'Renk: beyaz see section 7', 'kokusuz'], chr(10)) AS value FROM k""",
    "label_values": f"""WITH {_K} SELECT k AS p_partkey, 'Item ' || k AS name, CAST(k % 14 AS VARCHAR) AS ph, CAST(NULL AS VARCHAR) AS flash, (k % 70) || ' mPas' AS viscosity, true AS is_label, 'Yoğunluk :|sıvı|c' || k || '|solvent' AS block FROM k""",
    "column_values": f"WITH {_K} SELECT k AS p_partkey, unnest(['physical_state', 'color', 'odor', 'density']) AS field, unnest(['sıvı', 'c' || k, 'solvent', '0,' || k]) AS value FROM k",
    "meaningful_values": f"WITH {_K} SELECT k AS p_partkey, 'a|b ' || k || CASE WHEN k % 2 = 0 THEN '' ELSE '|c' END AS kept, CAST(CASE WHEN k % 2 = 0 THEN 2 ELSE 3 END AS INTEGER) AS n, k % 2 = 1 AS last FROM k",
    "no_data_values": f"WITH {_K} SELECT k AS p_partkey, k % 4 IN (0, 2) AS no_data, k % 4 = 3 AS suspicious FROM k",
    "child_tables": _children_sql(),
    "reprocess_preview": f"""WITH {_K}, j AS (SELECT *, k % 10 <> 0 AS known, CASE WHEN k % 10 = 0 THEN 'unknown_document' WHEN k % 7 = 0 THEN 'ufi_mismatch' END AS refusal FROM k)
        SELECT k AS doc_id, 'product_name' AS field, 'Old name' AS stored, p_name AS parsed, refusal FROM j WHERE known AND k % 3 = 0
        UNION ALL SELECT k, 'ufi', 'AAAA-MN1G-R608-0000', 'V873-MN1G-R608-' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0'), refusal FROM j WHERE known AND k % 7 = 0
        UNION ALL SELECT k, NULL, NULL, NULL, refusal FROM j WHERE NOT known OR (k % 3 <> 0 AND k % 7 <> 0)""",
    "backfill_profile": f"""WITH {_K} SELECT k AS doc_id, CASE WHEN k % 3 = 0 THEN '' ELSE {CAS_SQL} END AS cas, concat('2', lpad(CAST(k % 100 AS VARCHAR), 2, '0'), '-181-', k % 10) AS ec_number,
        concat('01-2119', lpad(CAST(k % 1000000 AS VARCHAR), 6, '0'), '-33-0001') AS reach_number, array_to_string(list_sort([{_H}[k % 10 + 1], {_H}[(k + 3) % 10 + 1]]), '|') AS codes FROM k""",
    "display_dates": """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '—' WHEN 1 THEN 'soon' ELSE strftime(o_orderdate, '%d.%m.%Y') END AS day,
        CASE WHEN o_orderkey % 4 = 0 THEN '—' ELSE day(o_orderdate) || ' ' || ['Oca', 'Şub', 'Mar', 'Nis', 'May', 'Haz', 'Tem', 'Ağu', 'Eyl', 'Eki', 'Kas', 'Ara'][month(o_orderdate)] || ' ' || year(o_orderdate) || ' 10:30' END AS time FROM orders""",
    "identifier_of": """WITH r AS (SELECT l_orderkey AS chemical_id, arg_min(CASE WHEN l_partkey % 5 = 0 THEN '' ELSE 'N' || l_partkey END, l_linenumber * 10000000 + l_partkey) AS found FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1)
        SELECT chemical_id, CASE WHEN found = '' THEN '—' ELSE found END AS identifier FROM r""",
    "code_lists": """SELECT l_orderkey AS doc_id, array_to_string(list_sort(list(DISTINCT 'H' || (l_partkey % 30))), '|') AS codes FROM lineitem WHERE l_partkey % 9 <> 0 GROUP BY 1""",
}
