"""Sections 7 to 9, structure, layout and recovery on hand-made sheets; entry without the optional part."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sheetwright.functions import layout, structure, text
from sheetwright.functions.handling import with_handling
from sheetwright.functions.properties import with_properties
from sheetwright.functions.protection import with_protection
from sheetwright.operators.facts import document_facts
from sheetwright.operators.sections import split_sections


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v")).alias("out")).first()["out"]


SEVEN = """SECTION 7: Handling and storage
7.1. Precautions
Advice on safe handling: Avoid contact with skin and eyes.
--- PAGE 3 ---
SAFETY DATA SHEET
Regulation text
www.example.com
Hygiene measures: Wash hands before every break.
Fire and explosion protection: Keep away from all ignition sources.
7.2 Storage
Storage conditions: Store in a cool dry place. Depolama sınıfı: 10 - yanıcı sıvılar Uyumsuz maddeler: Strong acids and oxidising agents.
7.3 Use
Use only as directed by the label. See 7.1 above."""


def test_handling(spark):
    rows = with_handling(spark.createDataFrame([(SEVEN,), (None,), ("short",)], "s string"), "s").select("handling.*").collect()
    assert rows[0].handling_precautions == ["Avoid contact with skin and eyes.", "Wash hands before every break."]
    assert rows[0].fire_explosion_precautions == ["Keep away from all ignition sources."]
    assert rows[0].storage_conditions == ["Store in a cool dry place.", "Depolama sınıfı 10 - yanıcı sıvılar"]
    assert rows[0].incompatible_materials == ["Strong acids and oxidising agents."]
    assert rows[0].specific_end_use == "Use Use only as directed by the label. See 7.1 above."
    assert rows[0].raw_subsection_7_3.startswith("7.3 Use") and "www.example.com" in rows[0].raw_subsection_7_1
    for row in rows[1:]:
        assert [v for v in row if v] == []


EIGHT = """8.1 Control parameters
TWA 5 ppm for acetone in air
Kaynak TWA STEL
DNEL workers 10 mg/kg
8.2 Exposure controls
Ensure good ventilation of the room. Provide eye wash stations.
8.2.2 Respiratory protection: Use filter A. Use full maskUse also gloves.
Hand protection Nitrile gloves >= 0,4 mm. Breakthrough over 8 hours.
Skin protection: Lab coat since 06.08.2013.
Please wash hands after work
Page 3 of 9"""


def test_protection(spark):
    rows = with_protection(spark.createDataFrame([(EIGHT,), (None,)], "s string"), "s").select("protection.*").collect()
    got = rows[0].asDict()
    assert got["respiratory_protection"] == ["Use filter A.", "Use full mask Use also gloves."]
    assert (got["glove_materials"], got["glove_thickness"]) == (["Nitrile gloves >= 0,4 mm."], [">= 0,4 mm"])
    assert got["engineering_controls"] == ["Ensure good ventilation of the room.", "Provide eye wash stations."]
    assert (got["exposure_limits"], got["dnel"], got["pnec"]) == (["TWA 5 ppm for acetone in air"], ["DNEL workers 10 mg/kg"], [])
    assert got["body_protection"] == ["Lab coat since 06.08.2013.", "Please wash hands after work"]
    assert got["hygiene_measures"] == ["Please wash hands after work"]
    assert set(map(len, rows[1])) == {0}


@pytest.mark.parametrize(
    ("nine", "field", "want"),
    [
        ("Buhar Basıncı (mmHg) @ 30°C 18", "vapour_pressure", "18 mmHg @ 30°C"),
        ("Bağıl Yoğunluk kg/l 20°C / 4°C 1.19", "density", "1.19 kg/l (20°C / 4°C)"),
        ("Viskozite cps @25°C 1.245", "viscosity", "1.245 cps @ 25°C"),
        ("Vapour pressure: 23 hPa (20°C)", "vapour_pressure", "23 hPa (20°C)"),
        ("Koku: yok The product is stable and holds no risk of Explosive properties bursting. Flammability: no", "explosive_properties", "yok The product is stable and holds no risk of bursting."),
    ],
)
def test_measures(spark, nine, field, want):
    assert with_properties(spark.createDataFrame([(nine,)], "s string"), "s").select(f"properties.{field}").first()[0] == want


@pytest.mark.parametrize("word", ["renksiz", "kokusuz", "kullanımları", "DNELs", "tripolyphosphate"])
def test_no_word_is_split(spark, word):
    assert one(spark, f"it is {word} here", structure.structured) == f"it is {word} here"


@pytest.mark.parametrize(
    ("text_", "want"),
    [
        ("a\t b\r\nc", "a b\nc"),
        ("a --- PAGE 2 --- b" + "_" * 25 + "c", "a\n--- PAGE 2 ---\nb\nc"),
        ("a\n--- PAGE 2 ---\n--- PAGE 3 ---b", "a\n--- PAGE 2 ---\n--- PAGE 3 ---\nb"),
        ("x SECTION 7: y, see section 8 z", "x\nSECTION 7: y, see section 8 z"),
        ("SECTION 7: y BÖLÜM 17: z", "SECTION 7: y BÖLÜM 17: z"),
        ("on 15.07.2016 a 8.2.1 b 17.1 c", "on 15.07.2016 a\n8.2.1  b 17.1 c"),
        ("Uyarı kelimesiDikkat Signal word Danger", "Uyarı kelimesi: Dikkat\nSignal word Danger"),
        ("x Renk: y güvenli depolama", "x\nRenk: y\ngüvenli\ndepolama"),
        ("x Renk: y güvenli elleçleme", "x\nRenk: y\ngüvenli\nelleçleme"),
        ("Colour: blue Product name X 2.1. Label elements H 315 P305 + 351", "Colour: blue\nProduct name X\n2.1.\nLabel elements H315 P305+P351"),
        ("renk: siz alev : lenir", "renksiz\nalevlenir"),
        ("\n\n\n a \n \n \n\n b \n", "a\n\nb"),
        (None, ""),
    ],
)
def test_structure(spark, text_, want):
    assert one(spark, text_, structure.structured) == want


def test_storage_class(spark):
    from sheetwright.functions.handling import storage_class

    for flat, want in [("Depolama sınıfı: 10 - yanıcı Uyumsuz maddeler: x", "Depolama sınıfı 10 - yanıcı"), ("Depolama sınıfı 8", "Depolama sınıfı 8"), ("Depolama sınıfı: yok Storage class 8A; b", "Storage class 8A"), ("none", None), (None, None)]:
        assert one(spark, flat, storage_class) == want


def test_spelled_words():
    import re

    from sheetwright.functions.pages import words

    for label, texts in {"Göz / yüz korunması": ["Göz/yüz  korunması", "Göz / yüz korunması"], "Specific end use (s)": ["Specific end use(s)", "Specific  end use (s)"], "7.1.1.2": ["7 . 1. 1.2"], "fire - and": ["fire–and"], "RMM": ["RMM"]}.items():
        assert all(re.fullmatch(words([label]), t) for t in texts), label
    assert not re.search(words(["RMM"]), "ARMMS")


def test_layout(spark):
    assert one(spark, "8.2.2 Hand protection : ", layout.label_key) == "hand protection"
    assert one(spark, ["Renk", "Koku: x"], lambda c: layout.field_value(c, ["renk"], ["renk", "koku"]), "array<string>") is None
    assert one(spark, ["Renk", "blue"], lambda c: layout.field_value(c, ["renk"], ["renk", "koku"]), "array<string>") == "blue"
    assert one(spark, ["-", None, " a "], layout.meaningful, "array<string>") == ["a"]


def test_recovery_and_references(spark):
    sheet = "SECTION 1: Identification\na\n2. Hazards identification\nb, see Section 7 for handling\n3.1 Composition and more\nSECTION 4: First aid\n14.1 x 5.1 Firefighting here\n8. Exposure controls"
    docs = spark.createDataFrame([(sheet, "mine"), (None, None)], "text string, tmp_0 string")
    rows = split_sections(docs).collect()
    assert set(rows[0].sections) == {1, 2, 3, 4, 5, 8}
    assert rows[0].sections[2] == "2. Hazards identification\nb, see Section 7 for handling"
    assert rows[0].sections[5] == "5.1 Firefighting here"
    assert rows[1].sections == {}
    assert rows[0].tmp_0 == "mine"


def test_facts_read_normalised_text(spark):
    docs = spark.createDataFrame([("SECTION 1: Identification\nProduct name: ﬁx Ã§ 10²",)], "text string")
    row = document_facts(docs).first()
    assert row.product_name == "fix ç 102"
    assert row.text == docs.first().text
    assert one(spark, None, text.nfkc) is None


def test_entry_without_a_library():
    """Where a library of the optional part is missing, the other queries are all there."""
    code = "import sys; sys.modules['ahocorasick'] = None\nimport __spark_entry__ as e\nassert len(e.queries()) > 60 and not any(q.startswith('op1') for q in e.queries())\nassert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parent.parent)
