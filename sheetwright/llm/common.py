"""Shared pieces of the llm operators: cut lineage, dense text features, connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one key are dealt to so many tasks where they meet the key's row.
SALTS = 4
_scratch: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one that ``spark.checkpoint.dir`` names.

    Where that is unset on one machine (tests) a temporary folder is made and set; on a cluster that is an
    error, since executors would write to disks that others can't read.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="sheetwright-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/sheetwright-{name}-{uuid.uuid4().hex}"
    if not _scratch:
        atexit.register(clear_scratch, spark)
    _scratch.add(path)
    return path


def clear_scratch(spark: SparkSession) -> None:
    """Delete every table that cut lineage. Call it in a long session between queries; results that read them end."""
    for path in list(_scratch):
        delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete ``path`` if the session still runs."""
    _scratch.discard(path)
    if spark.sparkContext._jsc is None:
        return
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).delete(target, True)


def saved(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: a later loss recomputes from the table."""
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_key(df: DataFrame, *keys: Column | str) -> DataFrame:
    """Deal rows out by ``keys`` over the session's shuffle partitions."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def beside(rows: DataFrame, keyed: DataFrame, key: str, spread: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``keyed``, which has one row for each ``key``, where a key may hold most rows.

    The rows of a key meet its row in several tasks, by the hash of ``spread``; and as both sides come straight
    from a shuffle, Spark can split what is still too large.
    """
    wide = keyed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(wide, [key, "salt"], how).drop("salt")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (a long, b long): rows (node, root), root the smallest node.

    Alternating large-star and small-star steps; each step is two joins on node minima and is written to
    the shared folder, so lineage stays short and an executor's loss costs one step; the step before is then
    deleted. A node with very many neighbours is salted, and only nodes whose edges change are joined at all.
    Nodes that are their own root come out too. Nulls and loops are no edges; an empty table gives an empty
    result.
    """
    spark = edges.sparkSession
    path = scratch_path(spark, "edges")
    now = saved(edges.where("a is not null and b is not null and a <> b").selectExpr("greatest(a, b) as u", "least(a, b) as v").distinct(), "edges", path)
    before = None
    while True:
        both = now.select("u", "v").union(now.selectExpr("v as u", "u as v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).where("m < u")  # other nodes keep their edges
        large = beside(both.where("v > u"), low, "u", "v", "left").selectExpr("v as u", "coalesce(m, u) as v").where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("most"))
        moved = beside(large, low.where("most > m").drop("most"), "u", "v").where("v <> m").selectExpr("v as u", "m as v")
        old, path = path, scratch_path(spark, "edges")
        now = saved(moved.union(low.selectExpr("u", "m as v")).distinct(), "edges", path)
        delete(spark, old)
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    return now.selectExpr("u as node", "v as root").union(now.selectExpr("v as node", "v as root")).groupBy("node").agg(F.min("root").alias("root"))


def on_table(function, **fixed):
    """``function(table, **fixed)`` in the form that ``applyInArrow`` takes."""

    def run(table: pa.Table) -> pa.Table:
        return function(table, **fixed)

    run.__annotations__ = {"table": pa.Table, "return": pa.Table}
    return run
