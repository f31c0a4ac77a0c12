"""Names and manufacturers of sheets in the spellings of section 1, and outside of it."""

from pyspark.sql import functions as F

from sheetwright.operators.facts import document_facts

HEAD = "SECTION 1: Identification\n"


CASES = [
    (HEAD + "Trade name: Acid X\nSupplier: Acme Ltd", "Acid X", "Acme Ltd"),
    (HEAD + "Product identifier\n  Acid X UFI: AAAA\nTedarikçi\n+90 (212) 1\na@b.com\nAcme A.Ş. Fax 1", "Acid X", "Acme A.Ş."),
    (HEAD + "TİCARİ ADI Acid X Ürün Kodu 7\nÜretici / Tedarikçi : Acme Adres: here", "Acid X", "Acme"),
    (HEAD + "- Madde adı: Trade name: Acid X\nManufacturer: undertaking\nFirma: Acme Ltd", "Acid X", "Acme Ltd"),
    (HEAD + "Trade name: Second\nÜrün adı: First\nManufacturer\n1\n2\n3\nToo far", "First", None),
    (HEAD + "1.1 The product name is Acid X 1.2 Use\nSupplier  Acme Ltd", "is Acid X", "Acme Ltd"),
    ("Commercial name: Acid X\nCompany:\nAcme Ltd\n" + HEAD + "Nothing", "Acid X", "Acme Ltd"),
    (HEAD + "Manufacturer: ABC\nSupplier: x", None, None),
    (None, None, None),
]


def test_section_1(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CASES)], "doc_id long, text string")
    for row in document_facts(docs).select("doc_id", "product_name", "manufacturer", "review_reasons").collect():
        _, name, maker = CASES[row["doc_id"]]
        assert (row["product_name"], row["manufacturer"]) == (name, maker)
        assert ("product_name_needs_review" in row["review_reasons"]) == (name is None)
        assert ("manufacturer_needs_review" in row["review_reasons"]) == (maker is None)


def test_rendered_spellings(spark):
    from sheetwright.sources.render import rendered

    d = "/root/testdata/sf0.001"
    got = document_facts(rendered(spark, d)).select("doc_id", "product_name", "manufacturer").collect()
    part = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name", F.when(F.col("p_partkey") % 13 != 0, F.concat("p_brand", F.lit(" Chemicals")))).collect()
    assert sorted(map(str, got)) == sorted(f"Row(doc_id={k}, product_name={name!r}, manufacturer={maker!r})" for k, name, maker in part)
