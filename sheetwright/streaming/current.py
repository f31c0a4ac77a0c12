"""Current revisions that follow a stream of uploads."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sheetwright.operators.commits import Batch, every_commit, live, rows_of
from sheetwright.operators.relational import current_revisions

TABLE = "current_revisions"


def follow_current(uploads: DataFrame, root: str, checkpoint: str, writer: str = "current") -> StreamingQuery:
    """Keep the current document of each chemical up to date in the store at ``root``, until no more uploads are waiting.

    ``uploads`` is a stream of documents as ``current_revisions`` takes them. The state holds, for each chemical, the
    partial fold of what has been seen (its first document, the first of its latest date, the highest version of that
    date); a micro-batch is folded before it is shuffled and merged with the state, so work grows with what is new. As
    the fold has a closed form, any split of the uploads, in any order, comes to the same result.

    A micro-batch writes the chemicals that it touched as a commit named by the query; one that is given again is done.
    """
    spark = uploads.sparkSession

    def write(changed: DataFrame, n: int) -> None:
        query = json.loads(spark.read.text(f"{checkpoint}/metadata").first()["value"])["id"]
        attempt = Batch(spark, root, f"{writer}-{query}", n)
        if attempt.done is None:
            attempt.write(TABLE, changed)
            attempt.commit()

    followed = current_revisions(uploads)
    return followed.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_table(spark: SparkSession, root: str) -> DataFrame:
    """(chemical_id, current_id) as the stream last saw it; empty before its first batch."""
    rows = rows_of(spark, root, TABLE, live(every_commit(spark, root)), "chemical_id long, current_id long")
    return rows.groupBy("chemical_id").agg(F.max_by("current_id", "place").alias("current_id"))
