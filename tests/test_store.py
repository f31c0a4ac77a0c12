"""Upload, restart, reprocessing and its preview on a store of Parquet tables."""

import pytest
from pyspark.sql import functions as F

from sheetwright.operators import store

HEAD = "SAFETY DATA SHEET\nSECTION 1: Identification\nProduct name: {name}\nManufacturer: {maker}\nUFI: {ufi}\nSECTION 2: Hazards identification\n{codes}\nSECTION 7: Handling and storage\n7.2 Storage\nStorage conditions: Keep in a cool and dry room.\nSECTION 8: Exposure controls\nHand protection: Wear nitrile gloves of 0,4 mm.\nSECTION 9: Physical properties\nColour: blue\n"


def sheet(name, maker="Acme Ltd", ufi="V873-MN1G-R608-8F3C", codes="H315 H319"):
    return HEAD.format(name=name, maker=maker, ufi=ufi, codes=codes)


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def _codes(spark, root):
    return sorted((r.doc_id, r.code) for r in store.read_table(spark, root, "hazard_codes").collect())


def _said(rows):
    return {r.doc_id: r.outcome for r in rows.collect()}


@pytest.fixture(scope="module")
def parsed_schema(spark):
    return store._parsed(_docs(spark, []).withColumn("file_hash", F.lit(""))).schema


@pytest.fixture
def quick(spark, monkeypatch, parsed_schema):
    """A reader of sheets that finds name, maker and codes only: what the store does with them is what counts."""

    def parse(docs):
        found = {"product_name": F.regexp_extract("text", "Product name: (.*)", 1), "manufacturer": F.regexp_extract("text", "Manufacturer: (.*)", 1), "hazard_codes": F.regexp_extract_all("text", F.lit(r"\bH\d+"), F.lit(0)), "ufi": F.lit("")}
        kept = [F.col(c) for c in docs.columns if c != "text"]
        return docs.select(*kept, *[(found[f.name] if f.name in found else F.lit(None).cast(f.dataType)).alias(f.name) for f in parsed_schema if f.name not in ("doc_id", "file_hash")])

    monkeypatch.setattr(store, "_parsed", parse)


def test_store(spark, tmp_path):
    root = str(tmp_path / "store")
    said = _said(store.upload(_docs(spark, [(1, sheet("Acid", ufi="")), (2, sheet("acid ", ufi="", codes="H302")), (3, sheet("Acid", ufi="")), (4, None)]), root, 0))
    assert said == {1: "stored", 2: "stored", 3: "known_content", 4: "stored"}
    docs = {r.doc_id: r for r in store.read_table(spark, root, "documents").collect()}
    assert set(docs) == {1, 2, 4}  # 3 has the text of 1
    assert docs[1].chemical_id == docs[2].chemical_id != docs[4].chemical_id
    assert store.read_table(spark, root, "chemicals").count() == 2
    assert _codes(spark, root) == [(1, "H315"), (1, "H319"), (2, "H302")]
    gloves = {r.doc_id: (r.glove_materials, r.glove_thickness) for r in store.read_table(spark, root, "ppe_info").collect()}
    assert gloves[1] == (["Wear nitrile gloves of 0,4 mm."], ["0,4 mm"])
    assert store.read_table(spark, root, "storage_info").where("doc_id = 1").first().storage_conditions == ["Keep in a cool and dry room."]
    assert {r.color for r in store.read_table(spark, root, "physical_properties").collect()} == {"blue"}

    second = _docs(spark, [(1, sheet("Acid", ufi="")), (5, sheet("Acid", codes="H290")), (6, sheet("Base"))])
    store.upload(second, root, 1)
    before = _codes(spark, root)
    assert _said(store.upload(second, root, 1)) == {1: "known_content", 5: "stored", 6: "stored"}
    assert _codes(spark, root) == before == [(1, "H315"), (1, "H319"), (2, "H302"), (5, "H290"), (6, "H315"), (6, "H319")]
    docs = {r.doc_id: r for r in store.read_table(spark, root, "documents").collect()}
    assert docs[5].chemical_id == docs[1].chemical_id != docs[6].chemical_id

    again = _docs(spark, [(1, sheet("Acid 2", ufi="", codes="H400")), (5, sheet("Acid", ufi="AAAA-MN1G-R608-8F3C")), (6, sheet("Base")), (77, sheet("x"))])
    seen = {(r.doc_id, r.field): (r.stored, r.parsed, r.refusal) for r in store.preview(again, root).collect()}
    assert seen[1, "product_name"] == ("Acid", "Acid 2", None)
    assert seen[5, "ufi"][2] == "ufi_mismatch"
    assert seen[6, None] == (None, None, None)
    assert seen[77, None][2] == "unknown_document"
    assert _codes(spark, root) == before
    assert _said(store.reprocess(again, root, 0)) == {1: "replaced", 5: "ufi_mismatch", 6: "replaced", 77: "unknown_document"}
    assert _codes(spark, root) == [(1, "H400"), (2, "H302"), (5, "H290"), (6, "H315"), (6, "H319")]
    after = {r.doc_id: r for r in store.read_table(spark, root, "documents").collect()}
    assert (after[1].product_name, after[1].file_hash, after[1].chemical_id) == ("Acid 2", docs[1].file_hash, docs[1].chemical_id)


def test_writers_of_one_store(spark, tmp_path, quick):
    """A stream, chemicals by hand and reprocessing share batch numbers; nothing is lost, and to run them again changes nothing."""
    from sheetwright.streaming.ingest import ingest_tables

    root = str(tmp_path / "store")
    hand = spark.createDataFrame([("Salt", "Acme Ltd", "S1"), ("Acid", "Acme Ltd", "A1")], "product_name string, manufacturer string, internal_code string")
    docs = _docs(spark, [(i, sheet(f"Name {i}", ufi="", codes=f"H30{i}")) for i in range(3)] + [(9, sheet("acid", ufi=""))])
    docs.coalesce(1).write.parquet(str(tmp_path / "in"))

    def stream(state):
        incoming = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
        ingest_tables(incoming, root, str(tmp_path / state)).awaitTermination(200)

    store.create_chemicals(spark, root, hand, 0)
    stream("state")
    store.reprocess(_docs(spark, [(1, sheet("Name 1", ufi="", codes="H400"))]), root, 0)

    def content():
        return {name: sorted(map(str, store.read_table(spark, root, name).collect())) for name in store.TABLES}

    whole = content()
    names = {r.product_name: r.id for r in store.read_table(spark, root, "chemicals").collect()}
    assert set(names) == {"Salt", "Acid", "Name 0", "Name 1", "Name 2"}
    assert store.read_table(spark, root, "documents").where("doc_id = 9").first().chemical_id == names["Acid"]
    assert _codes(spark, root) == [(0, "H300"), (1, "H400"), (2, "H302"), (9, "H315"), (9, "H319")]
    store.create_chemicals(spark, root, hand, 0)
    stream("state")
    stream("other state")  # a stream that starts anew finds all contents known
    store.reprocess(_docs(spark, [(1, sheet("Name 1", ufi="", codes="H999"))]), root, 0)
    assert content() == whole
    # Compaction changes no row, nor does what is deleted after it; later batches go on.
    store.compact(spark, root, 0)
    assert content() == whole
    assert store.clean_up(spark, root) > 0
    assert content() == whole
    assert _said(store.upload(_docs(spark, [(2, sheet("Other")), (20, sheet("Name 2", ufi="", codes="H302")), (21, sheet("New")), (None, sheet("Newer"))]), root, 0)) == {2: "id_taken", 20: "known_content", 21: "stored", None: "id_missing"}
    assert {r.doc_id for r in store.read_table(spark, root, "documents").collect()} == {0, 1, 2, 9, 21}


def test_attempts_side_by_side(spark, tmp_path, quick):
    """Broken attempts are never seen; of two writers with one content, or one id, the first commit counts."""
    from sheetwright.operators.commits import Batch

    root = str(tmp_path / "store")
    store.upload(_docs(spark, [(1, sheet("Acid"))]), root, 0)
    broken = Batch(spark, root, "upload", 1)
    broken.write("hazard_codes", spark.createDataFrame([(1, "H999")], "doc_id long, code string"))
    assert _codes(spark, root) == [(1, "H315"), (1, "H319")]
    # Two writers see the same store, then commit one after the other.
    from sheetwright.operators import store as module

    second = Batch(spark, root, "b", 0)
    store.upload(_docs(spark, [(2, sheet("Base", codes="H290")), (3, sheet("Salt", codes="H302"))]), root, 0, "a")
    made = module.Batch
    module.Batch = lambda *_: second
    try:
        store.upload(_docs(spark, [(4, sheet("Base", codes="H290")), (3, sheet("Sugar", codes="H350"))]), root, 0, "b")
    finally:
        module.Batch = made
    assert _codes(spark, root) == [(1, "H315"), (1, "H319"), (2, "H290"), (3, "H302")]
    # A slower attempt at a batch that is done leaves the faster one's rows.
    slow = Batch(spark, root, "c", 0)
    store.create_chemicals(spark, root, spark.createDataFrame([("X", "Y", "Z")], "product_name string, manufacturer string, internal_code string"), 0, "c")
    slow.write("chemicals", spark.createDataFrame([(5, "Late", None, None)], "id long, product_name string, manufacturer string, internal_code string"))
    slow.commit()
    names = {r.product_name for r in store.read_table(spark, root, "chemicals").collect()}
    assert "X" in names and "Late" not in names


def test_stream_to_tables(spark, tmp_path, quick):
    from sheetwright.streaming.ingest import ingest_tables

    docs = _docs(spark, [(i, sheet(f"Name {i % 3}", ufi="", codes=f"H30{i % 3}")) for i in range(6)])
    docs.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
        ingest_tables(stream, str(tmp_path / "store"), str(tmp_path / "state")).awaitTermination(200)
    assert store.read_table(spark, str(tmp_path / "store"), "documents").select(F.min("doc_id"), F.count("*")).first() == (0, 3)
