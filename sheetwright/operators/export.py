"""An assessment's workbook: the rows of its four sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwright.functions.lexicon import AMOUNT_NAMES, CONTROL_APPROACHES, EXPORT, EXPOSURE_NAMES
from sheetwright.operators.reports import display_date
from sheetwright.sources.files import safe_file_name

_BLANK = "—"


def _text(value: Column, blank: str = _BLANK) -> Column:
    return F.coalesce(F.nullif(value.cast("string"), F.lit("")), F.lit(blank))


def _listed(values: Column, by: str = ", ") -> Column:
    return F.array_join(F.coalesce(values, F.array().cast("array<string>")), by)


def _named(value: Column, names: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), value)


def workbook_rows(drafts: DataFrame, platform: str = "Sheetwright") -> DataFrame:
    """(workbook, sheet_no, sheet, row_no, cells) of assessed uses, for ``write_workbooks``.

    ``drafts`` has the fields of the form (``process_name``, ``department``, ``exposed_workers``,
    ``occupational_exposure_limit``, ``amount_value``, ``amount_unit``, ``physical_form``, ``dustiness``,
    ``process_temperature``, ``closed_system``, ``local_exhaust``, ``general_ventilation``, ``existing_ppe``,
    ``existing_controls``), those of the chemical (``product_name``, ``manufacturer``, ``cas_number``, ``sds_id``,
    ``revision_date``, ``boiling_point``, ``hazard_codes``, ``precautionary_codes``, ``ghs_codes``) and ``assessment``.
    Missing values show a dash; ``platform`` is the summary's first line. Each draft is one workbook; all its rows come from its one row, without a shuffle.
    """
    c, a = F.col, lambda f: F.col(f"assessment.{f}")
    number = a("control_number")
    title = _named(number.cast("string"), {str(n): texts[0] for n, texts in CONTROL_APPROACHES.items()})
    control = F.concat(F.lit("CA"), number.cast("string"), F.lit(" - "), title)
    state = F.when(a("needs_review"), EXPORT["review"]).otherwise(EXPORT["done"])
    amount = F.concat_ws(" ", F.coalesce(c("amount_value").cast("string"), F.lit("")), F.coalesce(c("amount_unit"), F.lit("")))
    heat = F.concat(F.nullif(c("process_temperature").cast("string"), F.lit("")), F.lit(" °C"))
    skin = F.when(a("skin_eye"), "S")
    size, exposure = _named(a("amount_band"), AMOUNT_NAMES), _named(a("exposure_band"), EXPOSURE_NAMES)
    controls = F.filter(F.array(*[F.concat(F.lit(f"{label}: "), F.nullif(c(f), F.lit(""))) for f, label in EXPORT["controls"].items()], F.nullif(c("existing_controls"), F.lit(""))), lambda x: x.isNotNull())
    codes = {"H": c("hazard_codes"), "P": c("precautionary_codes"), "GHS": c("ghs_codes")}
    analysis = [
        _text(c("product_name")), _text(c("cas_number")), _text(c("occupational_exposure_limit")), _text(c("department")), _text(c("exposed_workers")), _text(_listed(codes["H"])), _text(_listed(codes["GHS"])),
        _text(a("hazard_group"), EXPORT["look"]), amount, _text(size), _text(c("physical_form")), _text(exposure), _text(c("boiling_point")), _text(heat), _text(skin), _text(control, EXPORT["expert"]), _text(a("sheet")),
        F.array_join(controls, "\n"), _listed(a("recommendations"), "\n"), state,
    ]
    values = [
        _text(c("product_name")), _text(c("manufacturer")), _text(c("cas_number")), c("sds_id").cast("string"), display_date(c("revision_date")), None, c("process_name"), _text(c("department")), _text(c("exposed_workers")),
        _text(c("occupational_exposure_limit")), amount, c("physical_form"), _text(c("dustiness")), _text(c("boiling_point")), _text(heat), None, _text(a("hazard_group"), EXPORT["unknown"]), _text(_listed(a("matched_codes"))),
        _text(size), _text(exposure), _text(skin), _text(control, EXPORT["unknown"]), _text(a("sheet")), F.when(a("skin_eye"), EXPORT["skin_sheets"]).otherwise(_BLANK), state, None, *[_text(_listed(v)) for v in codes.values()], None,
        F.lit(EXPORT["method"]), F.lit(EXPORT["warning"]),
    ]
    cells = lambda *texts: F.array(*[t if isinstance(t, Column) else F.lit(t) for t in texts])
    labels = iter(EXPORT["summary"])
    summary = [cells(platform, ""), cells(EXPORT["title"], ""), cells("", "")] + [cells("", "") if v is None else cells(next(labels), v) for v in values]
    advice = F.coalesce(a("recommendations"), F.array().cast("array<string>"))
    advice = F.when(F.size(advice) > 0, F.transform(advice, lambda x, i: F.array((i + 1).cast("string"), x))).otherwise(F.array(cells("1", EXPORT["no_advice"])))
    every = F.flatten(F.array(*[_pairs(EXPORT["kinds"][kind], v) for kind, v in codes.items()]))
    every = F.when(F.size(every) > 0, every).otherwise(F.array(cells(*EXPORT["no_codes"])))
    sheets = [F.array(cells(*EXPORT["columns"]), cells(*analysis)), F.array(*summary), F.concat(F.array(cells(*EXPORT["advice"])), advice), F.concat(F.array(cells(*EXPORT["codes"])), every)]
    rows = F.flatten(F.array(*[_numbered(i, name, rows) for i, (name, rows) in enumerate(zip(EXPORT["sheets"], sheets, strict=True), 1)]))
    name = F.concat(F.lit("ILO_COSHH_"), safe_file_name(F.coalesce(c("product_name"), F.lit(""))), F.lit("_"), safe_file_name(F.coalesce(c("process_name"), F.lit(""))), F.lit(".xlsx"))
    return drafts.select(name.alias("workbook"), F.explode(rows).alias("r")).select("workbook", "r.*")


def _pairs(kind: str, values: Column) -> Column:
    return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.array(F.lit(kind), x))


def _numbered(number: int, name: str, rows: Column) -> Column:
    return F.transform(rows, lambda cells, i: F.struct(F.lit(number).alias("sheet_no"), F.lit(name).alias("sheet"), (i + 1).cast("int").alias("row_no"), cells.alias("cells")))
