"""Nested answers about sheets: the golden record of a hand-made sheet, and published tables that join without a shuffle."""

import json

from test_store import sheet

from sheetwright.operators import store
from sheetwright.operators.answers import golden, parsed_answers, publish, published_answers

SHEET = """GÜVENLİK BİLGİ FORMU Hazırlama Tarihi: 15.05.2018
--- PAGE 1 ---
BÖLÜM 1: Madde/Karışımın ve şirketin/dağıtıcının kimliği 1.1. Madde/Karışımın kimliği
Ürün Adı: Bazik Kanal Açıcı Ürün Kodu: BK2307
UFI: V873-MN1G-R608-8F3C UFI: F2D6-U05E-800G-VATG Tedarikçi: Örnek Kimya Sanayi
BÖLÜM 2: Zararlılık tanımlanması 2.2. Etiket unsurları Uyarı kelimesiDikkat
Zararlılık İfadeleri H 315 Cilt tahrişine yol açar. H319 Ciddi göz tahrişine yol açar. H290 Metaller için aşındırıcı olabilir. EUH205
Önlem İfadeleri P280 P234 P305 + P351+P338 P332+P313 P337+313 P302+352
BÖLÜM 3: Bileşimi/İçindekiler hakkında bilgi
Potasyum hidroksit CAS No: 1310-58-3 Index 019-002-00-8 EC No: 215-181-3
BÖLÜM 7: Elleçleme ve depolama
7.2. Güvenli depolama Depolama koşulları: Serin ve kuru yerde saklayın. Depolama sınıfı: 8 - aşındırıcı maddeler
BÖLÜM 8: Maruz kalma kontrolleri
8.2.2 El koruması: Nitril eldiven kullanın, en az 0,4 mm.
BÖLÜM 9: Fiziksel ve kimyasal özellikler
Renk: renksiz pH: ~11.4
Erime noktası: < 0 °C
Kaynama noktası: > 100 °C
Buhar basıncı: 23hPa (20°C)
Bağıl yoğunluk: 1.56 g/cm3
Suda çözünürlük: Tamamen karışabilir
BÖLÜM 16: Diğer bilgiler
Revizyon tarihi: 15.07.2021 Versiyon: Version 3
"""


def test_golden_record(spark):
    """The values that the reference checks of one sheet, on a hand-made sheet that holds them."""
    docs = spark.createDataFrame([(1, SHEET), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r.record for r in golden(docs).collect()}
    got = rows[1]
    assert got.section_numbers == [1, 2, 3, 7, 8, 9, 16] and got.section_count == 7
    assert (got.section_1.product_name, got.section_1.product_code, got.section_1.ufi) == ("Bazik Kanal Açıcı", "BK2307", "V873-MN1G-R608-8F3C; F2D6-U05E-800G-VATG")
    assert set(got.section_2.hazard_codes) == {"H315", "H319", "H290"}
    assert set(got.section_2.precautionary_codes) == {"P280", "P234", "P305+P351+P338", "P332+P313", "P337+P313", "P302+P352"}
    assert (got.section_2.signal_word, got.section_2.ghs_codes) == ("Dikkat", [])
    assert (got.section_3.cas_numbers, got.section_3.ec_numbers) == (["1310-58-3"], ["215-181-3"])
    assert got.section_7.storage_conditions == ["Serin ve kuru yerde saklayın.", "Depolama sınıfı 8 - aşındırıcı maddeler"]
    assert got.section_8.glove_thickness == ["0,4 mm"]
    nine = got.section_9
    assert (nine.ph, nine.boiling_point, nine.vapour_pressure, nine.density, nine.solubility) == ("~11.4", "> 100 °C", "23hPa (20°C)", "1.56 g/cm3", "Tamamen karışabilir")
    assert nine.melting_freezing_point.startswith("< 0")
    assert (str(got.revision.revision_date), got.revision.version) == ("2021-07-15", "3")
    assert set(got.ingestion_summary.ghs_codes) == {"GHS07", "GHS05"}
    empty = rows[2]
    assert (empty.character_count, empty.section_count, empty.section_1, empty.section_9) == (0, 0, None, None)
    assert empty.ingestion_summary.needs_review


def test_published_answers(spark, tmp_path):
    """Equal buckets join without an exchange, and say what the parsed rows say."""
    root = str(tmp_path / "store")
    docs = spark.createDataFrame([(i, sheet(f"Name {i}", ufi="" if i % 2 else "V873-MN1G-R608-8F3C", codes=f"H30{i} H315")) for i in range(4)] + [(9, "no sheet")], "doc_id long, text string")
    store.upload(docs, root, 0)
    try:
        publish(spark, root, "sheets", str(tmp_path / "published"), buckets=3)
        answers = published_answers(spark, "sheets")
        plan = answers._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        got = {r.doc_id: json.loads(r.a) for r in answers.selectExpr("doc_id", "to_json(answer) as a").collect()}
    finally:
        for name in ("documents", "sections", "hazard_codes", "precautionary_codes", "ghs_codes", "identifiers", "storage_info", "ppe_info", "physical_properties"):
            spark.sql(f"DROP TABLE IF EXISTS sheets_{name}")
    parsed = parsed_answers(spark.read.parquet(f"{root}/_parsed"), ["product_name"])
    want = {r.doc_id: json.loads(r.a) for r in parsed.selectExpr("doc_id", "to_json(answer) as a").collect()}
    assert set(got) == set(want) == {0, 1, 2, 3, 9}
    for doc in want:
        assert got[doc].pop("document").get("product_name") == want[doc].pop("document").get("product_name")
        assert got[doc] == want[doc]
    assert [s["section_number"] for s in got[1]["sections"]] == [1, 2, 7, 8, 9]
