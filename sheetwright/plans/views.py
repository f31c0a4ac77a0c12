"""The domain's tables as views of the driver's: chemicals from customer, documents from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Rows that one task parses at most, at about two milliseconds each.
TASK_ROWS = 50_000


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Narrow rows dealt to all cores and to more tasks as they grow, since one small file is one task.

    The rows are counted from the files' footers; a task's time is then bounded whatever the size of the table.
    """
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))
    return rows.repartition(tasks, *keys)


_CHEMICALS = """c_custkey AS id, {c_name} AS product_name, CASE WHEN c_custkey % 11 = 0 THEN ' ' ELSE concat('Maker ', c_nationkey) END AS manufacturer, concat('C', c_custkey % 500) AS internal_code"""
_DOCUMENTS = """o_orderkey AS id, o_custkey AS chemical_id, o_orderdate AS uploaded_at,
    CASE WHEN o_orderkey % 7 <> 0 THEN {day} END AS revision_date, CASE WHEN o_orderkey % 3 = 0 THEN {day2} END AS preparation_date,
    CASE WHEN o_orderkey % 4 <> 0 THEN concat(o_orderkey % 3 + 1, '.', o_orderkey % 13) END AS version,
    CASE o_orderstatus WHEN 'P' THEN 'needs_review' WHEN 'O' THEN 'sections_extracted' ELSE 'sections_incomplete' END AS processing_status"""


def chemicals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*_split(_CHEMICALS.format(c_name="c_name")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*_split(_DOCUMENTS.format(day="date_add(date'2015-01-01', int(o_custkey % 40 + o_orderkey % 5))", day2="date_add(date'2015-01-01', int(o_orderkey % 60))")))


CHEMICALS_SQL = f"chemicals AS (SELECT {_CHEMICALS.format(c_name='c_name')} FROM customer)"
DOCUMENTS_SQL = f"documents_ AS (SELECT {_DOCUMENTS.format(day='CAST(DATE ' + chr(39) + '2015-01-01' + chr(39) + ' + CAST(o_custkey % 40 + o_orderkey % 5 AS INTEGER) AS DATE)', day2='CAST(DATE ' + chr(39) + '2015-01-01' + chr(39) + ' + CAST(o_orderkey % 60 AS INTEGER) AS DATE)')} FROM orders)"


def _split(select: str) -> list[str]:
    """The items of a select list: commas outside parentheses part them."""
    out, depth, item = [], 0, ""
    for c in select:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(item)
            item = ""
        else:
            item += c
    return [x.strip() for x in [*out, item]]
