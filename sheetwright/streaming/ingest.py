"""Incremental ingest: new files of a folder, each content once."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from sheetwright.operators.facts import document_facts
from sheetwright.operators.store import upload


def document_stream(spark: SparkSession, path: str, schema: StructType, text: str = "text") -> DataFrame:
    """A stream of the Parquet documents that arrive under ``path``, with ``file_hash``; repeated contents are dropped.

    The state holds one hash for each content, so it grows with the number of documents ever seen.
    """
    docs = spark.readStream.schema(schema).parquet(path)
    return docs.withColumn("file_hash", F.sha2(F.col(text), 256)).dropDuplicates(["file_hash"])


def ingest(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append the facts of each new document to ``out`` as Parquet, then stop when no more are waiting."""
    facts = document_facts(stream).drop("text")
    return facts.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_tables(stream: DataFrame, root: str, checkpoint: str, writer: str = "stream") -> StreamingQuery:
    """Upload each micro-batch of (doc_id, text) to the store at ``root``, then stop when no more are waiting.

    Contents that the store has are skipped by a join with its documents, so no state grows. Batches are named by
    ``writer``, the id that the checkpoint gives the query, and the micro-batch: one that is given again after a failure
    is done already, and a stream that starts anew with another checkpoint has names of its own.
    """
    spark = stream.sparkSession

    def write(docs: DataFrame, n: int) -> None:
        query = json.loads(spark.read.text(f"{checkpoint}/metadata").first()["value"])["id"]
        upload(docs, root, n, f"{writer}-{query}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
