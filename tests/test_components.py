"""Component names and REACH numbers of section 3."""

from sheetwright.operators.facts import document_facts


def test_components(spark):
    text = "SECTION 3: Composition\nChemical composition:\nAcid X\nMadde adı (IUPAC): Base Y\nchemical name ACID x\nREACH 01-2119487136-33-0001, 01-2119487136-33-0001 and 01-2119000000-12-0002, 101-2119000000-12-0002"
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["component_names"], r["component_reach"]) for r in document_facts(docs).select("doc_id", "component_names", "component_reach").collect()}
    assert got == {1: (["Acid X", "Base Y"], ["01-2119487136-33-0001", "01-2119000000-12-0002"]), 2: ([], [])}


def test_rendered_components(spark):
    from sheetwright.sources.render import rendered

    d = "/root/testdata/sf0.001"
    got = document_facts(rendered(spark, d)).select("doc_id", "component_names", "component_reach", "component_cas", "component_ec").collect()
    names = {r.p_partkey: r.p_name for r in spark.read.parquet(f"{d}/part.parquet").collect()}
    assert {r.doc_id: r.component_names for r in got} == {k: [v] for k, v in names.items()}
    assert all(r.component_reach == [f"01-2119{r.doc_id % 1000000:06d}-33-0001"] for r in got)
    assert all(len(r.component_cas) == (r.doc_id % 3 != 0) and r.component_ec for r in got)
