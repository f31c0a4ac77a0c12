"""Pages of paged documents (PDF) as a Spark source, in batch and as a stream.

No PDF library is part of this repository, so the caller brings the function that reads one: bytes to the texts of the
pages. ``pages_source`` makes a data source of it, with another reader to fall back on. Files are dealt to tasks by
their size; a file is read by one task, a page is a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

Extract = Callable[[bytes], list[str]]
SCHEMA = "path string, file_hash string, page int, text string, reader string, problem string"
#: Bytes of files that a task reads, at least one file.
TASK_BYTES = 64 << 20


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def pages_source(extract: Extract, fallback: Extract | None = None, name: str = "sheet_pages", suffix: str = ".pdf") -> type[DataSource]:
    """A data source class: register it, then ``spark.read.format(name).load(folder)`` or ``readStream``.

    Rows: path, file_hash, page (from 1), text, reader (``first`` or ``fallback``), problem. Where ``extract`` fails or
    finds no text, ``fallback`` reads the file; a file that neither reads is one row without a page that names the
    problem. Files below the folder with ``suffix``, in any case, are read. A stream takes files in the order of
    (time of change, path), so a file must not arrive with a time before those already read.
    """

    def listed(folder: str) -> list[tuple[int, str, int]]:
        """(time in microseconds, path, size), in order."""
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(folder) if ":" in folder.split("/")[0] else (fs.LocalFileSystem(), folder)
        found = files.get_file_info(fs.FileSelector(path, recursive=True))
        return sorted(((f.mtime_ns or 0) // 1000, f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(suffix.lower()))

    def dealt(files: list[tuple[int, str, int]]) -> list[_Files]:
        out: list[_Files] = []
        held = TASK_BYTES
        for _, path, size in files:
            if held + size > TASK_BYTES:
                out.append(_Files([]))
                held = 0
            out[-1].paths.append(path)
            held += size
        return out

    def rows(folder: str, partition: _Files) -> Iterator[tuple]:
        from pyarrow import fs

        files, _ = fs.FileSystem.from_uri(folder) if ":" in folder.split("/")[0] else (fs.LocalFileSystem(), folder)
        for path in partition.paths:
            with files.open_input_stream(path) as content:
                data = content.read()
            digest, problem = hashlib.sha256(data).hexdigest(), None
            for reader, read in (("first", extract), ("fallback", fallback)):
                if read is None:
                    continue
                try:
                    pages = read(data)
                except Exception as error:  # a broken file must not end the job: its row tells
                    problem = f"{reader}: {error}"
                    continue
                if any((p or "").strip() for p in pages):
                    yield from ((path, digest, n, p or "", reader, None) for n, p in enumerate(pages, 1))
                    break
                problem = f"{reader}: no text"
            else:
                yield path, digest, None, None, None, problem

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.folder = options["path"]

        def partitions(self) -> list:
            return dealt(listed(self.folder))

        def read(self, partition: _Files) -> Iterator[tuple]:
            return rows(self.folder, partition)

    class StreamReader(DataSourceStreamReader):
        def __init__(self, options: dict):
            self.folder = options["path"]

        def initialOffset(self) -> dict:
            return {"time": -1, "path": ""}

        def latestOffset(self) -> dict:
            files = listed(self.folder)
            return {"time": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

        def partitions(self, start: dict, end: dict) -> list:
            after, until = (start["time"], start["path"]), (end["time"], end["path"])
            return dealt([f for f in listed(self.folder) if after < f[:2] <= until])

        def read(self, partition: _Files) -> Iterator[tuple]:
            return rows(self.folder, partition)

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options)

        def streamReader(self, schema) -> DataSourceStreamReader:
            return StreamReader(self.options)

    return Pages


def whole_texts(pages: DataFrame) -> DataFrame:
    """(path, file_hash, text, problem): pages put together, each below its mark ``--- PAGE n ---``."""
    page = F.struct("page", F.concat(F.lit("\n--- PAGE "), F.col("page").cast("string"), F.lit(" ---\n"), F.col("text")).alias("text"))
    listed = F.array_sort(F.collect_list(F.when(F.col("page").isNotNull(), page)))
    joined = F.btrim(F.array_join(F.transform(listed, lambda p: p["text"]), "\n"), F.lit(" \n\t\r"))
    return pages.groupBy("path", "file_hash").agg(F.nullif(joined, F.lit("")).alias("text"), F.max("problem").alias("problem"))


def read_sheets(spark: SparkSession, folder: str, extract: Extract, fallback: Extract | None = None) -> DataFrame:
    """The whole texts of the PDF files below ``folder``."""
    spark.dataSource.register(pages_source(extract, fallback))
    return whole_texts(spark.read.format("sheet_pages").load(folder))
