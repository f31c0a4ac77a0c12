"""Inventory reports, search and the review queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetwright.functions.lexicon import MONTH_NAMES, STATUS_LABELS, TEST_NAMES
from sheetwright.functions.text import lower_tr

NO_MAKER, NO_SHEET = "(none)", "no_sds"
MISSING_MAKER = "Üretici bilgisi yok"


def inventory_totals(summary: DataFrame) -> DataFrame:
    """One row: chemicals, documents, chemicals with and without a current document, documents to review."""
    return summary.agg(
        F.count("*").alias("chemicals"),
        F.coalesce(F.sum("total_documents"), F.lit(0)).alias("documents"),
        F.count_if(F.col("current_id").isNotNull()).alias("with_current"),
        F.count_if(F.col("current_id").isNull()).alias("without_current"),
        F.coalesce(F.sum("needs_review_count"), F.lit(0)).alias("needs_review"),
    )


def by_manufacturer(chemicals: DataFrame) -> DataFrame:
    """Manufacturers with their number of chemicals and share in percent, the largest first."""
    name = F.coalesce(F.nullif(F.trim("manufacturer"), F.lit("")), F.lit(NO_MAKER))
    total = chemicals.agg(F.count("*").alias("total"))
    counts = chemicals.groupBy(name.alias("manufacturer")).agg(F.count("*").alias("chemicals"))
    return counts.join(F.broadcast(total)).select("manufacturer", "chemicals", (F.col("chemicals") * 100.0 / F.col("total")).alias("share")).orderBy(F.desc("chemicals"), "manufacturer")


def manufacturer_report(chemicals: DataFrame, collation: str = "tr") -> DataFrame:
    """Manufacturers by their number of chemicals, ties in the order of a language: position, manufacturer, chemicals.

    Missing makers count under a name of their own. Makers with the same count are ranked among themselves, in one task
    that sorts them and may spill, behind all with larger counts; different counts are few (their sum is at most the
    number of chemicals).
    """
    name = F.coalesce(F.nullif(F.trim("manufacturer"), F.lit("")), F.lit(MISSING_MAKER))
    counts = chemicals.groupBy(name.alias("manufacturer")).agg(F.count("*").alias("chemicals"))
    sizes = counts.groupBy("chemicals").agg(F.count("*").alias("same"))
    above = Window.orderBy(F.desc("chemicals")).rowsBetween(Window.unboundedPreceding, -1)
    larger = sizes.select("chemicals", F.coalesce(F.sum("same").over(above), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("chemicals").orderBy(F.collate("manufacturer", collation), "manufacturer"))
    return counts.withColumn("own", own).join(larger, "chemicals").select((F.col("own") + F.col("before")).alias("position"), "manufacturer", "chemicals")


def by_status(summary: DataFrame, docs: DataFrame) -> DataFrame:
    """Chemicals by the status of their current document."""
    status = docs.select(F.col("id").alias("current_id"), "processing_status")
    return summary.select("id", "current_id").join(status, "current_id", "left").groupBy(F.coalesce("processing_status", F.lit(NO_SHEET)).alias("processing_status")).agg(F.count("*").alias("chemicals"))


def recent(summary: DataFrame, docs: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` current documents that were uploaded last."""
    times = docs.select(F.col("id").alias("current_id"), "uploaded_at")
    return summary.select(F.col("id").alias("chemical_id"), "current_id").join(times, "current_id").orderBy(F.desc("uploaded_at"), F.desc("current_id")).limit(n)


def needs_attention(summary: DataFrame) -> DataFrame:
    return summary.where((F.col("current_id").isNull()) | (F.col("needs_review_count") > 0))


def review_queue(summary: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents that need review, with their chemical."""
    return docs.where("processing_status = 'needs_review'").join(summary.select(F.col("id").alias("chemical_id"), "product_name", "manufacturer"), "chemical_id")


def search(chemicals: DataFrame, term: str, fields: list[str]) -> DataFrame:
    """Chemicals of which a field holds ``term``, by Turkish lower case; a blank term finds all."""
    if not term.strip():
        return chemicals
    hit = F.lit(False)
    for field in fields:
        hit = hit | F.contains(lower_tr(F.coalesce(field, F.lit(""))), lower_tr(F.lit(term.strip())))
    return chemicals.where(hit)


def eligible(summary: DataFrame) -> DataFrame:
    """Chemicals that can be assessed: a current document, and no test names."""
    tidy = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return summary.where(F.col("current_id").isNotNull() & ~tidy("product_name").isin(TEST_NAMES) & ~tidy("manufacturer").isin(TEST_NAMES))


def status_label(status: Column) -> Column:
    """The display text of a status: an unknown one is shown as it is, a missing one as a dash."""
    table = F.create_map(*[F.lit(x) for pair in STATUS_LABELS.items() for x in pair])
    tidy = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    return F.when(tidy == "", "—").otherwise(F.coalesce(F.try_element_at(table, tidy), status))


def row_status(summary: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, state) of each chemical: review, empty, pending, error or ready, the first that holds."""
    status = docs.select(F.col("id").alias("current_id"), "processing_status")
    rows = summary.join(status, "current_id", "left")
    state = F.when(F.col("needs_review_count") > 0, "review").when(F.col("current_id").isNull(), "empty").when(F.col("processing_status") == "pending", "pending").when(F.col("processing_status") == "failed", "error").otherwise("ready")
    return rows.select("id", state.alias("state"))


def numbered(rows: DataFrame, key: str, values: str, blank: str) -> DataFrame:
    """(key, number, value): the values of an array, numbered from 1; a placeholder where there is none."""
    filled = F.when(F.size(values) > 0, F.col(values)).otherwise(F.array(F.lit(blank)))
    return rows.select(key, F.posexplode(filled).alias("at", "value")).select(key, (F.col("at") + 1).alias("number"), "value")


def display_date(value: Column) -> Column:
    """A date as day.month.year; what is no date is shown as it is, a missing one as a dash."""
    text = F.trim(value.cast("string"))
    day = F.try_to_date(text, "yyyy-MM-dd")
    return F.when(F.coalesce(text, F.lit("")) == "", "—").otherwise(F.coalesce(F.date_format(day, "dd.MM.yyyy"), text))


def display_time(value: Column) -> Column:
    """A time as day month year hour:minute with the Turkish month's short name; a missing one as a dash."""
    at = F.try_to_timestamp(F.trim(value.cast("string")))
    month = F.element_at(F.array(*map(F.lit, MONTH_NAMES)), F.month(at))
    shown = F.concat(F.dayofmonth(at).cast("string"), F.lit(" "), month, F.date_format(at, " yyyy HH:mm"))
    return F.when(F.coalesce(F.trim(value.cast("string")), F.lit("")) == "", "—").otherwise(F.coalesce(shown, value.cast("string")))
