"""Rendered safety data sheets: one text for each row of ``part``, every fact a function of its key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwright.plans.views import dealt

#: Values that keys pick from, in order.
HAZARDS = ["H315", "H302", "H314", "H351", "H340", "H290", "H350i", "H319", "H360FD", "H225"]
PRECAUTIONS = ["P280", "P305 + P351 + 338", "P302+352", "P264"]
SIGNALS = ["Danger", "Warning"]
STATES = ["Katı", "Sıvı", "Toz", "Gaz"]
NAME_LABELS = ["Product name: ", "Ürün adı: ", "Trade name: ", "• Ticari Adı ", "Product identifier:\\n", "MADDE ADI : ", "Madde/Karışım adı: ", "Code sheet, Ürün ismi: ", "Commercial name: "]
MAKER_LABELS = ["Manufacturer: ", "Supplier: ", "Tedarikçi:\\n", "Firma Adı: ", "Company name: ", "Üretici / Tedarikçi\\n+90 212 000\\ninfo@example.com\\n", "İmalatçı : ", "Supplier ", "Company: "]
MAKER_ENDS = ["", " Tel: 0212", " Address: Main street 1", " E-posta: a@example.com"]
MONTHS_TR = ["Oca", "Şub", "Mar", "Nis", "May", "Haz", "Tem", "Ağu", "Eyl", "Eki", "Kas", "Ara"]
MONTHS_EN = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
TITLES = [
    "Identification of the substance", "Zararlılık tanımlanması", "Composition and ingredients", "İlk yardım önlemleri", "Firefighting measures", "Kaza sonucu yayılma", "Handling and storage",
    "Maruz kalma kontrolleri", "Physical and chemical properties", "Kararlılık ve tepkime", "Toxicological information", "Ekolojik bilgiler", "Disposal considerations", "Taşımacılık bilgileri",
    "Regulatory information", "Diğer bilgiler",
]


def _pick(values: list[str], index: str) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + f")[{index}]"


#: k: the key. The check digit is wrong for every third key.
_CAS = "concat(100 + k, '-', lpad(k % 97, 2, '0'))"
_DIGIT = f"aggregate(transform(filter(split(reverse(replace({_CAS}, '-', '')), ''), c -> c <> ''), (c, i) -> int(c) * (i + 1)), 0, (a, x) -> a + x) % 10"
_DAY = "date_add(date'2015-01-01', int(k % 3000))"
_DATE = (
    f"CASE k % 4 WHEN 0 THEN date_format({_DAY}, 'yyyy-MM-dd') WHEN 1 THEN date_format({_DAY}, 'd.M.yyyy') "
    f"WHEN 2 THEN concat(day({_DAY}), '-', {_pick(MONTHS_TR, f'month({_DAY}) - 1')}, '-', year({_DAY})) "
    f"ELSE concat({_pick(MONTHS_EN, f'month({_DAY}) - 1')}, ' ', day({_DAY}), ', ', year({_DAY})) END"
)


def _body(n: int) -> str:
    """SQL for the text of section ``n`` below its heading."""
    return {
        1: f"concat({_pick(NAME_LABELS, 'int(k % 9)')}, name, '\\nProduct code: BK', k, '\\nUFI: V873-MN1G-R608-', lpad(k % 10000, 4, '0'), '\\n', if(k % 13 = 0, '', concat({_pick(MAKER_LABELS, 'int(k % 9)')}, brand, ' Chemicals', if(k % 9 < 7, {_pick(MAKER_ENDS, 'int(k % 4)')}, ''))), '\\n')",
        2: f"concat('Hazard statements ', {_pick(HAZARDS, 'int(k % 10)')}, ' EUH208 ', {_pick(HAZARDS, 'int((k + 3) % 10)')}, '\\n', {_pick(PRECAUTIONS, 'int(k % 4)')}, '\\nSignal word: ', {_pick(SIGNALS, 'int(k % 2)')}, '\\n')",
        3: f"concat('CAS ', {_CAS}, '-', ({_DIGIT} + if(k % 3 = 0, 1, 0)) % 10, ' index 019-002-00-8\\nEC No: 2', lpad(k % 100, 2, '0'), '-181-', k % 10, '\\n', if(k % 2 = 0, 'Chemical name: ', 'Chemical composition:\\n'), name, '\\nREACH No: 01-2119', lpad(k % 1000000, 6, '0'), '-33-0001\\n')",
        7: "concat('Keep closed.', if(k % 5 = 0, ' For disposal see Section 13 of this sheet.', ''), '\\n')",
        9: f"concat('State: ', {_pick(STATES, 'int(k % 4)')}, '\\nBoiling point: ', size * 10, ' °C\\n')",
        16: f"concat('Revision date: ', {_DATE}, '\\nVersion: ', k % 9 + 1, '.', k % 5, '\\n')",
    }.get(n, f"'General text of part {n}.\\n'")


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): sheets of all parts. Every seventh lacks section 12, every eleventh its title, every thirteenth a maker."""
    part = dealt(spark.read.parquet(f"{sf_dir.rstrip('/')}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_size"), "p_partkey")
    sections = []
    for n in range(1, 17):
        word = "SECTION" if n % 2 else "BÖLÜM"
        text = f"concat('{word} {n}: {TITLES[n - 1]}\\n', {_body(n)})"
        sections.append(f"if(k % 7 = 0, '', {text})" if n == 12 else text)
    whole = "concat(if(k % 11 = 0, '', 'SAFETY DATA SHEET\\n'), " + ", ".join(sections) + ")"
    return part.selectExpr("p_partkey as k", "p_name as name", "p_brand as brand", "p_size as size").select(F.col("k").alias("doc_id"), F.expr(whole).alias("text"))
