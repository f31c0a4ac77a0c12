"""XLSX workbooks as a Spark sink and source, without a library beyond the standard one.

Rows are (workbook, sheet_no, sheet, row_no, cells). A task streams the sheets of its workbooks as XML into zip files,
holding a row at a time, under names of its own; the driver renames them once all tasks are done and deletes them if
the job fails, so a folder never shows half a workbook. A workbook is one file, so one task writes it.
"""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "workbook string, sheet_no int, sheet string, row_no int, cells array<string>"
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACK = "http://schemas.openxmlformats.org/package/2006"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
#: Limits of the format: rows and columns of a sheet, characters of a cell and of a sheet's name.
MOST_ROWS, MOST_COLUMNS, MOST_CHARS, MOST_NAME = 1_048_576, 16_384, 32_767, 31


def _place(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def column_name(n: int) -> str:
    """A, B, ..., Z, AA, ... for 0, 1, ..."""
    out = ""
    n += 1
    while n:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


def _legal(text: str) -> str:
    """Without characters that XML can't hold."""
    return "".join(c for c in text if c in "\t\n\r" or 0x20 <= ord(c) <= 0xD7FF or 0xE000 <= ord(c) <= 0xFFFD or ord(c) > 0xFFFF)


def _row_xml(number: int, cells: list) -> str:
    if number > MOST_ROWS or len(cells) > MOST_COLUMNS or any(c is not None and len(c) > MOST_CHARS for c in cells):
        raise ValueError(f"row {number} is beyond what a sheet can hold")
    cell = lambda i, c: f'<c r="{column_name(i)}{number}" t="inlineStr"><is><t xml:space="preserve">{escape(_legal(c), {chr(13): "&#13;"})}</t></is></c>'
    return f'<row r="{number}">{"".join(cell(i, c) for i, c in enumerate(cells) if c is not None)}</row>'


class _Workbook:
    """A workbook that is being written: sheets one after another, rows in order."""

    def __init__(self, sink, widths: list[list[int]]):
        self.zip, self.widths, self.sheets, self.open = zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED), widths, [], None

    def row(self, sheet: str, number: int, cells: list) -> None:
        if not self.sheets or self.sheets[-1] != sheet:
            self._end_sheet()
            self.sheets.append(sheet)
            self.open = self.zip.open(f"xl/worksheets/sheet{len(self.sheets)}.xml", "w")
            widths = self.widths[len(self.sheets) - 1] if len(self.sheets) <= len(self.widths) else []
            columns = "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(widths, 1))
            self.open.write(f'{_HEAD}<worksheet xmlns="{_MAIN}">{f"<cols>{columns}</cols>" if columns else ""}<sheetData>'.encode())
        self.open.write(_row_xml(number, cells).encode())

    def _end_sheet(self) -> None:
        if self.open:
            self.open.write(b"</sheetData></worksheet>")
            self.open.close()
            self.open = None

    def close(self) -> None:
        self._end_sheet()
        numbers = range(1, len(self.sheets) + 1)
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{n}.xml" ContentType="{kind}.worksheet+xml"/>' for n in numbers)
        names = "".join(f'<sheet name={quoteattr(s[:MOST_NAME])} sheetId="{n}" r:id="rId{n}"/>' for n, s in zip(numbers, self.sheets, strict=True))
        links = "".join(f'<Relationship Id="rId{n}" Type="{_RELS}/worksheet" Target="worksheets/sheet{n}.xml"/>' for n in numbers)
        for name, body in {
            "[Content_Types].xml": f'<Types xmlns="{_PACK}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{parts}</Types>',
            "_rels/.rels": f'<Relationships xmlns="{_PACK}/relationships"><Relationship Id="rId1" Type="{_RELS}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_RELS}"><sheets>{names}</sheets></workbook>',
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACK}/relationships">{links}</Relationships>',
        }.items():
            self.zip.writestr(name, _HEAD + body)
        self.zip.close()


class _Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"].rstrip("/")
        self.draft = f"{self.path}/_temporary-{uuid.uuid4().hex}"
        self.widths = [[int(w) for w in sheet.split(",") if w] for sheet in options.get("widths", "").split(";")]
        self.overwrite = overwrite

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        files, draft = _place(self.draft)
        files.create_dir(draft, recursive=True)
        made, book, sink, now = [], None, None, None
        for r in rows:
            if book is None or r["workbook"] != now:
                if book:
                    book.close()
                    sink.close()
                now = r["workbook"]
                made.append((f"{draft}/{uuid.uuid4().hex}", now))
                sink = files.open_output_stream(made[-1][0])
                book = _Workbook(sink, self.widths)
            book.row(r["sheet"], r["row_no"], list(r["cells"] or []))
        if book:
            book.close()
            sink.close()
        return _Written(made)

    def commit(self, messages: list) -> None:
        files, path = _place(self.path)
        names = [name for m in messages if m for _, name in m.files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("a workbook's rows came from several tasks: write them with write_workbooks")
        if self.overwrite:
            from pyarrow import fs

            for old in files.get_file_info(fs.FileSelector(path)):
                if old.type == fs.FileType.File:
                    files.delete_file(old.path)
        for m in messages:
            for draft, name in m.files if m else ():
                files.move(draft, f"{path}/{name}")
        files.delete_dir(_place(self.draft)[1])
        files.open_output_stream(f"{path}/_SUCCESS").close()

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        files, draft = _place(self.draft)
        if files.get_file_info(draft).type == fs.FileType.Directory:
            files.delete_dir(draft)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _texts(archive: zipfile.ZipFile, part: str) -> Iterator[tuple[int, list]]:
    """(row number, cells) of a sheet, a row at a time."""
    tag = lambda name: f"{{{_MAIN}}}{name}"
    with archive.open(part) as content:
        for _, row in ElementTree.iterparse(content):
            if row.tag == tag("row"):
                cells: dict[int, str] = {}
                for c in row.iter(tag("c")):
                    at = 0
                    for letter in c.get("r").rstrip("0123456789"):
                        at = at * 26 + ord(letter) - 64
                    cells[at - 1] = "".join(t.text or "" for t in c.iter(tag("t")))
                yield int(row.get("r")), [cells.get(i) for i in range(max(cells, default=-1) + 1)]
                row.clear()


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")

    def partitions(self) -> list:
        from pyarrow import fs

        files, path = _place(self.path)
        return [_File(f.path) for f in files.get_file_info(fs.FileSelector(path)) if f.path.endswith(".xlsx")]

    def read(self, partition: _File) -> Iterator[tuple]:
        files, _ = _place(self.path)
        with files.open_input_file(partition.path) as content, zipfile.ZipFile(content) as archive:
            sheets = ElementTree.fromstring(archive.read("xl/workbook.xml")).iter(f"{{{_MAIN}}}sheet")
            for n, sheet in enumerate(sheets, 1):
                for row, cells in _texts(archive, f"xl/worksheets/sheet{n}.xml"):
                    yield partition.path.rsplit("/", 1)[-1], n, sheet.get("name"), row, cells


class Workbooks(DataSource):
    """``xlsx``: a folder of workbooks with inline texts, as this sink writes them."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, overwrite)


def write_workbooks(rows: DataFrame, path: str, widths: list[list[int]] | None = None, mode: str = "append") -> None:
    """Write (workbook, sheet_no, sheet, row_no, cells) as files under ``path``; ``widths`` of columns for each sheet.

    The workbook's name is the file's. Rows of a workbook come together in a task, sorted, by a shuffle; a missing cell
    is left out. Rows beyond the format's limits are an error, since to leave them out would lose them.
    """
    rows.sparkSession.dataSource.register(Workbooks)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.selectExpr("workbook", "int(sheet_no) as sheet_no", "sheet", "int(row_no) as row_no", "cells").repartition(tasks, "workbook").sortWithinPartitions("workbook", "sheet_no", "row_no")
    sorted_.write.format("xlsx").option("widths", ";".join(",".join(map(str, w)) for w in widths or [])).mode(mode).save(path)


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(Workbooks)
    return spark.read.format("xlsx").load(path)
