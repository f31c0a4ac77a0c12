"""Queries of control banding, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetwright.functions import banding
from sheetwright.functions.lexicon import AMOUNTS, CONTROL_MATRIX, EXPOSURES, HAZARD_GROUPS, REFUSALS, SKIN_EYE
from sheetwright.operators.export import workbook_rows
from sheetwright.operators.facts import physical_form
from sheetwright.operators.reports import numbered
from sheetwright.plans.views import table

_CODES = [c for group in HAZARD_GROUPS.values() for c in group] + ["H999"]
_UNITS = ["g", "ML ", "kg", "Litre", "ton", "m3", "box"]
_FORMS = ["Katı", "Sıvı", "KATI", "liquid", "Gaz", ""]
_DUST = ["Düşük", "orta", "YÜKSEK", "low", "HIGH", "?"]


def _array(values: list[str]):
    return F.array(*map(F.lit, values))


def _uses(spark, d):
    """Inputs of an assessment for each line item: codes, amount, unit, form, dustiness, temperatures."""
    k = F.col("l_partkey")
    pick = lambda values, index: F.element_at(_array(values), (index % len(values) + 1).cast("int"))
    return table(spark, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"),
        F.array(pick(_CODES, k), F.lower(pick(_CODES, k + F.col("l_suppkey")))).alias("codes"),
        F.when(k % 13 == 0, "x").otherwise(F.col("l_quantity").cast("long").cast("string")).alias("amount"),
        pick(_UNITS, k).alias("unit"),
        pick(_FORMS, F.col("l_suppkey")).alias("form"),
        pick(_DUST, F.col("l_orderkey")).alias("dust"),
        F.when(k % 7 != 0, F.concat(F.lit("> "), (k % 300).cast("string"), F.lit(",5 °C"))).alias("boiling"),
        F.when(k % 5 == 0, ((k % 10) * 10).cast("string")).alias("process"),
        F.when(k % 2 == 0, "LEV").alias("existing"),
    )


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_USES_SQL = f"""uses AS (SELECT l_orderkey || '-' || l_linenumber AS id, {_list(_CODES)}[l_partkey % {len(_CODES)} + 1] AS c1, {_list(_CODES)}[(l_partkey + l_suppkey) % {len(_CODES)} + 1] AS c2,
    CASE WHEN l_partkey % 13 = 0 THEN 'x' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS amount,
    {_list(["Small", "Small", "Medium", "Medium", "Large", "Large", ""])}[l_partkey % 7 + 1] AS unit_band, {_list(["solid", "liquid", "solid", "liquid", "other", ""])}[l_suppkey % 6 + 1] AS kind,
    {_list(["Low", "Medium", "High", "Low", "", ""])}[l_orderkey % 6 + 1] AS dust_band, CASE WHEN l_partkey % 7 <> 0 THEN l_partkey % 300 + 0.5 END AS bp,
    CASE WHEN l_partkey % 5 = 0 THEN (l_partkey % 10) * 10.0 ELSE 25.0 END AS pt, l_partkey % 2 = 0 AS has_controls, l_suppkey % 6 IN (0, 2) AS dusty FROM lineitem)"""


def _group(code: str) -> str:
    return "CASE " + " ".join(f"WHEN {code} IN ({', '.join(repr(c) for c in members)}) THEN '{g}'" for g, members in HAZARD_GROUPS.items()) + " END"


_MATRIX_SQL = "matrix(grp, amount_band, cell, number) AS (VALUES " + ", ".join(f"('{g}', '{a}', '{e}', {n})" for g, amounts in CONTROL_MATRIX.items() for a, row in amounts.items() for e, n in row.items()) + ")"
_SKIN = ", ".join(repr(c) for c in SKIN_EYE)
_ASSESS_SQL = f"""WITH {_USES_SQL}, {_MATRIX_SQL},
    b AS (SELECT *, greatest({_group("c1")}, {_group("c2")}) AS grp, list_filter(list_distinct([c1, c2]), lambda c: c IN ({_SKIN})) AS skin,
                 CASE WHEN amount <> 'x' AND CAST(amount AS DOUBLE) > 0 THEN nullif(unit_band, '') END AS amount_band,
                 CASE WHEN bp <= 20 THEN NULL WHEN bp <= 2 * pt + 10 THEN 'High' WHEN bp >= 5 * pt + 50 THEN 'Low' WHEN bp IS NOT NULL THEN 'Medium' END AS volatile FROM uses),
    e AS (SELECT *, CASE kind WHEN 'solid' THEN nullif(dust_band, '') WHEN 'liquid' THEN volatile END AS exposure_band FROM b),
    a AS (SELECT e.*, m.number FROM e LEFT JOIN matrix m ON m.grp = e.grp AND m.amount_band = e.amount_band
          AND m.cell = CASE WHEN exposure_band = 'Medium' THEN CASE WHEN kind = 'solid' THEN 'MediumSolid' ELSE 'MediumLiquid' END ELSE exposure_band END)"""


def _assessed(spark, d):
    uses = _uses(spark, d)
    return banding.with_assessment(uses, *[F.col(c) for c in ("codes", "amount", "unit", "form", "dust", "boiling", "process", "existing")], name="a").select("id", "a")


def _refusals(spark, d):
    """Uses that lack something: a chemical, its document, a process, an amount, a form, a dustiness, or nothing."""
    k = F.col("l_partkey")
    lacks = lambda n, value: F.when(k % 11 == n, F.lit(None)).when((k + F.col("l_suppkey")) % 17 == n, F.lit("")).otherwise(F.lit(value))
    rows = table(spark, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.when(k % 13 != 0, k).alias("chosen"), F.when(k % 7 != 0, k).alias("current"), F.when(k % 5 == 0, "  ").otherwise("Mixing").alias("process"),
        lacks(2, "5").alias("amount"), F.when(k % 3 == 0, "Katı").otherwise(lacks(3, "Sıvı")).alias("form"), lacks(4, "Orta").alias("dust"),
    )
    return rows.select("id", banding.refusal(*[F.col(c) for c in ("chosen", "current", "process", "amount", "form", "dust")]).alias("refusal"))

def _workbooks(spark, d):
    """Codes and some lines of the summary in the workbooks of one draft for each part."""
    k, none = F.col("p_partkey"), F.lit(None).cast("string")
    fields = {
        "product_name": F.col("p_name"), "manufacturer": F.col("p_brand"), "cas_number": none, "sds_id": k, "revision_date": F.concat(F.lit("2020-01-1"), (k % 10).cast("string")), "process_name": F.concat(F.lit("Mix "), k.cast("string")),
        "amount_value": (k % 5).cast("string"), "amount_unit": F.lit("kg"), "physical_form": F.when(k % 2 == 0, "Katı").otherwise("Sıvı"), "dustiness": F.lit("Orta"), "boiling_point": F.concat((F.col("p_size") * 10).cast("string"), F.lit(" °C")),
        "hazard_codes": F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.element_at(_array(_CODES), (k % len(_CODES) + 1).cast("int")))), "precautionary_codes": F.when(k % 3 == 0, F.array(F.lit("P280"), F.lit("P264"))), "ghs_codes": F.array().cast("array<string>"),
        **{c: none for c in ("department", "exposed_workers", "occupational_exposure_limit", "process_temperature", "closed_system", "local_exhaust", "general_ventilation", "existing_ppe", "existing_controls")},
    }
    drafts = table(spark, d, "part").select(*[v.alias(n) for n, v in fields.items()])
    drafts = banding.with_assessment(drafts, *[F.col(c) for c in ("hazard_codes", "amount_value", "amount_unit", "physical_form", "dustiness", "boiling_point", "process_temperature", "existing_controls")])
    rows = workbook_rows(drafts).where("sheet_no = 4 or sheet_no = 2 and row_no in (4, 7, 8, 10, 14, 15, 17, 20, 22)")
    return rows.select("workbook", "sheet_no", "row_no", F.array_join("cells", "|").alias("cells"))


QUERIES = {
    "export_workbooks": _workbooks,
    "assessment_refusals": _refusals,
    "hazard_group": lambda s, d: _uses(s, d).select("id", banding.hazard_group(F.col("codes"))["grp"].alias("grp")),
    "skin_eye": lambda s, d: _uses(s, d).select("id", F.size(banding.skin_eye_codes(F.col("codes"))).alias("codes")),
    "amount_band": lambda s, d: _uses(s, d).select("id", banding.amount_band(F.col("amount"), F.col("unit")).alias("band")),
    "dustiness": lambda s, d: _uses(s, d).select("id", banding.dustiness(F.col("dust")).alias("band")),
    "numeric_parse": lambda s, d: _uses(s, d).select("id", banding.numeric_value(F.col("boiling")).alias("value")),
    "volatility": lambda s, d: _uses(s, d).select("id", banding.volatility(F.col("boiling"), F.col("process"))["band"].alias("band"), banding.volatility(F.col("boiling"), F.col("process"))["status"].alias("status")),
    "control_matrix": lambda s, d: s.range(60).select(
        F.element_at(_array(list(CONTROL_MATRIX)), (F.col("id") / 12 + 1).cast("int")).alias("grp"),
        F.element_at(_array(AMOUNTS), (F.col("id") / 4 % 3 + 1).cast("int")).alias("amount_band"),
        F.element_at(_array(EXPOSURES), (F.col("id") % 4 + 1).cast("int")).alias("cell"),
    ).withColumn("number", banding.matrix_number(F.col("grp"), F.col("amount_band"), F.col("cell"))),
    "coshh_full": lambda s, d: _assessed(s, d).select("id", *[f"a.{c}" for c in ("hazard_group", "skin_eye", "amount_band", "exposure_band", "control_number", "control_status", "needs_review")]),
    "control_approach_counts": lambda s, d: _assessed(s, d).groupBy("a.hazard_group", "a.sheet").agg(F.count("*").alias("uses")),
    "recommendations": lambda s, d: _assessed(s, d).select("id", F.size("a.recommendations").alias("texts")),
    "export_recommendation_rows": lambda s, d: numbered(_assessed(s, d).select("id", F.when(F.col("a.control_number").isNotNull(), F.col("a.matched_codes")).otherwise(F.array().cast("array<string>")).alias("codes")), "id", "codes", "-").groupBy("number").agg(F.count("*").alias("rows"), F.count_if(F.col("value") == "-").alias("blanks")),
    "physical_form_detect": lambda s, d: table(s, d, "part").select("p_partkey", physical_form(F.element_at(_array(["Toz hali", "SIVI", "sıvı", "Buhar", "Jel"]), (F.col("p_partkey") % 5 + 1).cast("int"))).alias("form")),
}

ORACLE_SQL = {
    "export_workbooks": f"""WITH d AS (SELECT p_partkey AS k, p_name, p_size, 'ILO_COSHH_' || replace(p_name, ' ', '_') || '_Mix_' || p_partkey || '.xlsx' AS workbook, CASE WHEN p_partkey % 4 <> 0 THEN {_list(_CODES)}[p_partkey % {len(_CODES)} + 1] END AS code FROM part),
        s AS (SELECT workbook, unnest([4, 7, 8, 10, 14, 15, 17, 20, 22]) AS row_no, unnest(['Kimyasal|' || p_name, 'SDS ID|' || k, 'SDS Revizyon|1' || (k % 10) || '.01.2020', 'Proses / Faaliyet|Mix ' || k, 'Kullanılan Miktar|' || (k % 5) || ' kg',
              'Fiziksel Form|' || CASE WHEN k % 2 = 0 THEN 'Katı' ELSE 'Sıvı' END, 'Kaynama Noktası|' || (p_size * 10) || ' °C', 'Tehlike Grubu|' || coalesce({_group("code")}, 'Belirlenemedi'), 'Miktar Grubu|' || CASE WHEN k % 5 = 0 THEN '—' ELSE 'Orta' END]) AS cells FROM d),
        c AS (SELECT workbook, list_concat(CASE WHEN code IS NULL THEN [] ELSE ['H Kodu|' || code] END, CASE WHEN k % 3 = 0 THEN ['P Kodu|P280', 'P Kodu|P264'] ELSE [] END) AS codes FROM d),
        r AS (SELECT workbook, list_concat(['Kategori|Kod'], CASE WHEN len(codes) = 0 THEN ['Bilgi|Tehlike kodu bulunamadı.'] ELSE codes END) AS codes FROM c)
        SELECT workbook, 2 AS sheet_no, row_no, cells FROM s UNION ALL SELECT workbook, 4, unnest(range(1, len(codes) + 1)), unnest(codes) FROM r""",
    "assessment_refusals": f"""WITH u AS (SELECT l_orderkey || '-' || l_linenumber AS id, l_partkey AS k, (l_partkey + l_suppkey) % 17 AS j FROM lineitem)
        SELECT id, CASE WHEN k % 13 = 0 THEN {REFUSALS[0]!r} WHEN k % 7 = 0 THEN {REFUSALS[1]!r} WHEN k % 5 = 0 THEN {REFUSALS[2]!r} WHEN k % 11 = 2 OR j = 2 THEN {REFUSALS[3]!r}
            WHEN k % 3 <> 0 AND (k % 11 = 3 OR j = 3) THEN {REFUSALS[4]!r} WHEN k % 3 = 0 AND (k % 11 = 4 OR j = 4) THEN {REFUSALS[5]!r} END AS refusal FROM u""",
    "hazard_group": f"WITH {_USES_SQL} SELECT id, greatest({_group('c1')}, {_group('c2')}) AS grp FROM uses",
    "skin_eye": f"WITH {_USES_SQL} SELECT id, len(list_filter(list_distinct([c1, c2]), lambda c: c IN ({_SKIN}))) AS codes FROM uses",
    "amount_band": f"WITH {_USES_SQL} SELECT id, CASE WHEN amount <> 'x' THEN nullif(unit_band, '') END AS band FROM uses",
    "dustiness": f"WITH {_USES_SQL} SELECT id, nullif(dust_band, '') AS band FROM uses",
    "numeric_parse": f"WITH {_USES_SQL} SELECT id, CAST(bp AS DOUBLE) AS value FROM uses",
    "volatility": f"{_ASSESS_SQL} SELECT id, volatile AS band, CASE WHEN bp IS NULL THEN 'needs_review' WHEN bp <= 20 THEN 'special_case' ELSE 'calculated' END AS status FROM b",
    "control_matrix": f"WITH {_MATRIX_SQL} SELECT * FROM matrix",
    "coshh_full": f"""{_ASSESS_SQL} SELECT id, grp AS hazard_group, len(skin) > 0 AS skin_eye, amount_band, exposure_band, number AS control_number,
        CASE WHEN number IS NULL THEN 'needs_review' ELSE 'calculated' END AS control_status, number IS NULL OR grp = 'E' AS needs_review FROM a""",
    "control_approach_counts": f"{_ASSESS_SQL} SELECT grp AS hazard_group, CASE WHEN number IS NOT NULL THEN concat('G', number, '00') END AS sheet, count(*) AS uses FROM a GROUP BY 1, 2",
    "recommendations": f"{_ASSESS_SQL} SELECT id, CASE WHEN number IS NULL THEN 0 ELSE 3 END + CASE WHEN len(skin) > 0 THEN 2 ELSE 0 END + CASE WHEN has_controls THEN 0 ELSE 1 END + CASE WHEN dusty THEN 1 ELSE 0 END AS texts FROM a",
    "export_recommendation_rows": f"""{_ASSESS_SQL}, n AS (SELECT CASE WHEN number IS NULL THEN 0 WHEN c1 <> c2 AND {_group("c1")} = {_group("c2")} THEN 2 ELSE 1 END AS codes FROM a),
        r AS (SELECT 1 AS number, codes = 0 AS blank FROM n UNION ALL SELECT 2, false FROM n WHERE codes = 2)
        SELECT number, count(*) AS rows, count(*) FILTER (blank) AS blanks FROM r GROUP BY 1""",
    "physical_form_detect": "SELECT p_partkey, ['Katı', 'Sıvı', 'Sıvı', 'Gaz', NULL][p_partkey % 5 + 1] AS form FROM part",
}
