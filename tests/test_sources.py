"""Workbooks and pages as data sources."""

import zipfile
from xml.dom import minidom

import pytest

from sheetwright.functions import banding
from sheetwright.functions.lexicon import EXPORT
from sheetwright.operators.export import workbook_rows
from sheetwright.sources.workbooks import column_name, read_workbooks, write_workbooks

FORM = ["process_name", "department", "exposed_workers", "occupational_exposure_limit", "amount_value", "amount_unit", "physical_form", "dustiness", "process_temperature", "closed_system", "local_exhaust", "general_ventilation", "existing_ppe", "existing_controls"]
CHEMICAL = ["product_name", "manufacturer", "cas_number", "sds_id", "revision_date", "boiling_point"]


@pytest.fixture(scope="module")
def drafts(spark):
    from pyspark.sql import functions as F

    full = ["Mixing <a> & b", "Lab", "2 / mixer", "5 ppm", "5", "kg", "Sıvı", "", "40", "yes", "fan", None, "gloves", "none\nelse", "Acid: x", "Acme", "64-19-7", "7", "2021-07-15", "118 °C"]
    rows = [(*full, ["H315", "H319"], ["P280"], ["GHS07"]), (*[None] * 20, [], None, None)]
    kind = ", ".join(f"{c} string" for c in [*FORM, *CHEMICAL]) + ", hazard_codes array<string>, precautionary_codes array<string>, ghs_codes array<string>"
    made = spark.createDataFrame(rows, kind)
    return banding.with_assessment(made, *[F.col(c) for c in ("hazard_codes", "amount_value", "amount_unit", "physical_form", "dustiness", "boiling_point", "process_temperature", "existing_controls")])


def test_workbook_of_an_assessment(drafts):
    rows = {(r.workbook, r.sheet_no, r.row_no): r.cells for r in workbook_rows(drafts).collect()}
    name, empty = "ILO_COSHH_Acid__x_Mixing__a__&_b.xlsx", "ILO_COSHH__.xlsx"
    assert {k[0] for k in rows} == {name, empty}
    assert rows[name, 1, 1] == EXPORT["columns"]
    assert rows[name, 1, 2][:10] == ["Acid: x", "64-19-7", "5 ppm", "Lab", "2 / mixer", "H315, H319", "GHS07", "A", "5 kg", "Orta"]
    assert rows[name, 1, 2][13:18] == ["40 °C", "S", "CA1 - Genel Havalandırma", "G100", "Kapalı sistem: yes\nLEV: fan\nKKD: gloves\nnone\nelse"]
    assert rows[name, 1, 2][19] == "Ön değerlendirme tamamlandı"
    summary = {cells[0]: cells[1] for (book, sheet, _), cells in rows.items() if book == name and sheet == 2}
    assert (summary["SDS Revizyon"], summary["Skin Rehberleri"], summary["P Kodları"]) == ("15.07.2021", "S100, S101, S102", "P280")
    assert [c[0] for (b, s, n), c in sorted(rows.items()) if b == name and s == 2 and c[0]] == ["Sheetwright", EXPORT["title"], *EXPORT["summary"]]
    assert rows[name, 3, 2][0] == "1" and rows[name, 4, 2] == ["H Kodu", "H315"] and rows[name, 4, 5] == ["GHS Kodu", "GHS07"]
    assert rows[empty, 4, 2] == EXPORT["no_codes"] and rows[empty, 1, 2][0] == "—" and rows[empty, 1, 2][19] == "Uzman incelemesi gerekli"


def test_workbooks_read_back(spark, drafts, tmp_path):
    """Four sheets of each workbook come back equal; the files are sound zips of sound XML; commits leave nothing behind."""
    path = str(tmp_path / "books")
    rows = workbook_rows(drafts)
    write_workbooks(rows, path, widths=EXPORT["widths"])

    def plain(df):
        """Cells without missing ones at the end, which a workbook doesn't hold."""
        return sorted((r.workbook, r.sheet_no, r.sheet, r.row_no, r.cells[: len(r.cells) - next((i for i, c in enumerate(reversed(r.cells)) if c is not None), 0)]) for r in df.collect())

    assert plain(read_workbooks(spark, path)) == plain(rows)
    files = sorted(p.name for p in (tmp_path / "books").iterdir())
    assert files == ["ILO_COSHH_Acid__x_Mixing__a__&_b.xlsx", "ILO_COSHH__.xlsx", "_SUCCESS"]
    with zipfile.ZipFile(tmp_path / "books" / files[0]) as archive:
        assert archive.testzip() is None
        for part in archive.namelist():
            minidom.parseString(archive.read(part))
        assert b'width="28"' in archive.read("xl/worksheets/sheet1.xml")
    write_workbooks(rows.where("workbook like '%Acid%'"), path, mode="overwrite")
    assert {r.workbook for r in read_workbooks(spark, path).select("workbook").distinct().collect()} == {files[0]}


def test_workbooks_that_fail(spark, tmp_path):
    """A row beyond the format's limits fails the job and leaves no file."""
    path = tmp_path / "books"
    rows = spark.createDataFrame([("a.xlsx", 1, "s", 1, ["ok", None, "\x00\r\n<"]), ("b.xlsx", 1, "s", 1, ["x" * 40_000])], "workbook string, sheet_no int, sheet string, row_no int, cells array<string>")
    with pytest.raises(Exception, match="beyond"):
        write_workbooks(rows, str(path))
    assert not path.exists() or not list(path.iterdir())
    write_workbooks(rows.limit(1), str(path))
    assert [r.cells for r in read_workbooks(spark, str(path)).collect()] == [["ok", None, "\r\n<"]]


def test_column_names():
    assert [column_name(n) for n in (0, 25, 26, 701, 702, 16_383)] == ["A", "Z", "AA", "ZZ", "AAA", "XFD"]


# --- pages -----------------------------------------------------------------------------------------------------------
def _extractors():
    """Two readers, made here so that workers get them by value."""

    def first(data):
        if data.startswith(b"broken"):
            raise ValueError("no such format")
        return data.decode().split("|")

    def second(data):
        if b"hopeless" in data:
            raise ValueError("nor this")
        return [data.decode().upper()]

    return first, second


def test_pages(spark, tmp_path):
    from sheetwright.sources.pages import pages_source, read_sheets, whole_texts

    _first, _second = _extractors()
    folder = tmp_path / "in"
    (folder / "deep").mkdir(parents=True)
    for name, data in {"a.pdf": "one|two", "deep/b.PDF": "broken x", "c.pdf": " \n", "d.pdf": "broken hopeless", "e.txt": "no"}.items():
        (folder / name).write_text(data)
    got = {r.path.rsplit("/", 1)[-1]: (r.text, r.problem) for r in read_sheets(spark, str(folder), _first, _second).collect()}
    assert got == {"a.pdf": ("--- PAGE 1 ---\none\n\n--- PAGE 2 ---\ntwo", None), "b.PDF": ("--- PAGE 1 ---\nBROKEN X", None), "c.pdf": (None, "fallback: no text"), "d.pdf": (None, "fallback: nor this")}
    alone = {r.path.rsplit("/", 1)[-1]: r.problem for r in read_sheets(spark, f"file://{folder}", _first).collect()}
    assert alone == {"a.pdf": None, "b.PDF": "first: no such format", "c.pdf": "first: no text", "d.pdf": "first: no such format"}
    spark.dataSource.register(pages_source(_first, _second))
    for more in ("", "f.pdf"):  # the second run finds what is new only
        if more:
            (folder / more).write_text("six")
        stream = spark.readStream.format("sheet_pages").load(str(folder))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.path.rsplit("/", 1)[-1], r.page or 0, r.reader or "") for r in rows.collect()) == [("a.pdf", 1, "first"), ("a.pdf", 2, "first"), ("b.PDF", 1, "fallback"), ("c.pdf", 0, ""), ("d.pdf", 0, ""), ("f.pdf", 1, "first")]
    assert whole_texts(rows).count() == 5


def test_pages_are_dealt_by_size(spark, tmp_path, monkeypatch):
    from sheetwright.sources import pages

    for i in range(5):
        (tmp_path / f"{i}.pdf").write_text("x" * 100)
    monkeypatch.setattr(pages, "TASK_BYTES", 250)
    reader = pages.pages_source(_extractors()[0])({"path": str(tmp_path)}).reader(None)
    assert [len(p.paths) for p in reader.partitions()] == [2, 2, 1]
