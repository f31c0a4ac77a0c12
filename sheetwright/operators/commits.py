"""A log of commits over a folder of Parquet tables, for writers that know nothing of each other.

A batch is named by its writer and a number. Each attempt at it writes folders of its own,
``<table>/part=<attempt>``, and counts only once its manifest stands at ``_commits/<writer>/<batch>.json``. No two
writers share a file, so none can overwrite another's rows, and what a broken attempt left behind is never read. A
batch that has a manifest is done: to run it again changes nothing.

Commits are ordered by a number that is larger than all a writer had seen when it began, then by writer and batch, so
every reader sees the same order. Manifests are few (one a batch); ``compact`` puts many batches into one.
"""

from __future__ import annotations

import json
import re
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

_MANIFEST = "writer string, batch long, number long, attempt string, tables array<string>, replaces array<string>"


class Commit(NamedTuple):
    number: int
    writer: str
    batch: int
    attempt: str
    tables: tuple[str, ...]
    replaces: tuple[str, ...]

    @property
    def name(self) -> str:
        return f"{self.writer}/{self.batch}"


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def every_commit(spark: SparkSession, root: str) -> list[Commit]:
    """All commits of a store in their order; none where there is no store yet."""
    files, folder = _file_system(spark, f"{root}/_commits")
    if not files.exists(folder):
        return []
    rows = spark.read.schema(_MANIFEST).json(f"{root}/_commits/*/*.json").collect()  # one for each batch
    return sorted(Commit(r.number, r.writer, r.batch, r.attempt, tuple(r.tables), tuple(r.replaces)) for r in rows)


def live(commits: list[Commit]) -> list[Commit]:
    """Those that no later one has taken in."""
    gone = {name for c in commits for name in c.replaces}
    return [c for c in commits if c.name not in gone]


def rows_of(spark: SparkSession, root: str, table: str, commits: list[Commit], schema: str | None = None) -> DataFrame:
    """The rows that ``commits`` wrote to a table, with ``place``, their commit's place in the order.

    Without any, an empty table of ``schema``, or an error where that isn't given.
    """
    mine = [(c.attempt, i) for i, c in enumerate(commits) if table in c.tables]
    if not mine:
        if schema is None:
            raise ValueError(f"nothing has been committed to {table} at {root}")
        return spark.createDataFrame([], f"{schema}, place int")
    rows = spark.read.option("basePath", f"{root}/{table}").parquet(*[f"{root}/{table}/part={a}" for a, _ in mine])
    return rows.join(spark.createDataFrame(mine, "part string, place int"), "part").drop("part")


class Batch:
    """One attempt at a batch. Write tables, then commit; ``done`` is the commit of an earlier attempt, if there is one."""

    def __init__(self, spark: SparkSession, root: str, writer: str, batch: int):
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", writer) or writer.startswith((".", "_")):
            raise ValueError(f"a writer's name is a folder's: {writer!r}")
        self.spark, self.root, self.writer, self.batch = spark, root, writer, int(batch)
        self.attempt = "a" + uuid.uuid4().hex
        self.seen = every_commit(spark, root)
        self.tables: list[str] = []
        own = [c for c in self.seen if (c.writer, c.batch) == (writer, self.batch)]
        self.done = own[0] if own else None

    @property
    def before(self) -> list[Commit]:
        """The commits that count for this batch."""
        return live(self.seen)

    def write(self, table: str, rows: DataFrame) -> DataFrame:
        """Write rows of a table, once for each table, and read them back."""
        path = f"{self.root}/{table}/part={self.attempt}"
        rows.write.parquet(path)
        self.tables.append(table)
        return self.spark.read.parquet(path)

    def commit(self, replaces: list[str] | None = None, number: int | None = None) -> None:
        """Make what was written count, all at once. If another attempt at this batch was faster, its rows count."""
        if number is None:
            number = 1 + max((c.number for c in self.seen), default=0)
        told = {"writer": self.writer, "batch": self.batch, "number": number, "attempt": self.attempt, "tables": sorted(self.tables), "replaces": sorted(replaces or [])}
        files, draft = _file_system(self.spark, f"{self.root}/_commits/_{self.attempt}")
        _, final = _file_system(self.spark, f"{self.root}/_commits/{self.writer}/{self.batch}.json")
        files.mkdirs(final.getParent())
        out = files.create(draft, True)
        out.write(bytearray(json.dumps(told).encode()))
        out.close()
        if files.exists(final) or not files.rename(draft, final):  # a manifest appears whole, by one rename
            files.delete(draft, False)
        self.seen = every_commit(self.spark, self.root)
        self.done = next(c for c in self.seen if (c.writer, c.batch) == (self.writer, self.batch))


def remove_unread(spark: SparkSession, root: str, tables: list[str]) -> int:
    """Delete the folders of attempts that no live commit names, and the manifests of batches that were taken in.

    For quiet times: an attempt that is still at work looks like one that broke, and a reader may still be reading
    batches that were taken in. Returns how many folders went.
    """
    commits = every_commit(spark, root)
    kept = {c.attempt for c in live(commits)}
    gone = 0
    for table in tables:
        files, folder = _file_system(spark, f"{root}/{table}")
        for status in files.listStatus(folder) if files.exists(folder) else []:
            name = status.getPath().getName()
            if name.startswith("part=") and name[5:] not in kept:
                gone += bool(files.delete(status.getPath(), True))
    for c in set(commits) - set(live(commits)):
        files, manifest = _file_system(spark, f"{root}/_commits/{c.name}.json")
        files.delete(manifest, False)
    return gone

