"""A whole sheet as one nested value: from parsed rows, from the store's tables, and as the golden record of one parse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwright.functions.structure import structured
from sheetwright.functions.text import normalised
from sheetwright.operators.facts import document_facts, with_details
from sheetwright.operators.store import read_table

#: Child tables of an answer: those that give lists, and those that give at most one struct.
LISTS, STRUCTS = ("sections", "hazard_codes", "precautionary_codes", "ghs_codes", "identifiers"), ("storage_info", "ppe_info", "physical_properties")


def publish(spark: SparkSession, root: str, prefix: str, path: str, buckets: int = 200) -> None:
    """Write the store's tables as catalog tables ``<prefix>_<name>`` under ``path``, dealt into ``buckets`` by doc_id and sorted.

    A table that is there is replaced. Answers then need no shuffle, however many are asked for.
    """
    for name in ("documents", *LISTS, *STRUCTS):
        rows = read_table(spark, root, name).repartition(buckets, "doc_id").write.mode("overwrite")
        rows.bucketBy(buckets, "doc_id").sortBy("doc_id").option("path", f"{path}/{name}").saveAsTable(f"{prefix}_{name}")


def published_answers(spark: SparkSession, prefix: str) -> DataFrame:
    """(doc_id, answer) of all published documents: equal buckets are joined where they lie."""
    docs = spark.table(f"{prefix}_documents")
    own = [c for c in docs.columns if c != "doc_id"]
    out = docs.select("doc_id", F.struct(*own).alias("document"))
    for name in LISTS:
        rows = spark.table(f"{prefix}_{name}")
        columns = [c for c in rows.columns if c != "doc_id"]
        value = F.struct(*columns) if len(columns) > 1 else F.col(columns[0])
        lists = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(value)).alias(name))  # rows of one sheet
        out = out.join(lists.hint("merge"), "doc_id", "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))
    for name in STRUCTS:
        rows = spark.table(f"{prefix}_{name}")
        columns = [c for c in rows.columns if c != "doc_id"]
        single = rows.groupBy("doc_id").agg(F.first(F.struct(*columns)).alias(name))
        out = out.join(single.hint("merge"), "doc_id", "left")
    return out.select("doc_id", _answer(F.col("sections"), F.col("document")).alias("answer"))


def _answer(sections: Column, document: Column) -> Column:
    """The nested form. Sections have no titles of their own: the field is there, and null."""
    shown = F.transform(sections, lambda s: F.struct(s["section_number"].alias("section_number"), F.lit(None).cast("string").alias("section_title"), s["content"].alias("content")))
    return F.struct(document.alias("document"), *[F.col(c) for c in (*LISTS[1:], *STRUCTS)], F.size(sections).alias("section_count"), shown.alias("sections"))


def parsed_answers(parsed: DataFrame, document: list[str]) -> DataFrame:
    """(doc_id, answer) of parsed documents (``with_details``), without tables in between."""
    from sheetwright.operators.store import child_arrays

    arrays = child_arrays()
    flat = lambda name: F.array_sort(F.transform(arrays[name], lambda x: x["code"]) if name.endswith("codes") else arrays[name])
    columns = {name: F.coalesce(flat(name), F.array().cast("array<string>")) if name.endswith("codes") else flat(name) for name in LISTS if name != "sections"}
    columns |= {name: F.try_element_at(arrays[name], F.lit(1)) for name in STRUCTS}
    made = parsed.select("doc_id", F.struct(*document).alias("document"), F.array_sort(arrays["sections"]).alias("sections"), *[v.alias(k) for k, v in columns.items()])
    return made.select("doc_id", _answer(F.col("sections"), F.col("document")).alias("answer"))


def golden(docs: DataFrame) -> DataFrame:
    """(doc_id, record) of ``docs`` (doc_id, text): all parsers over the normalised, structured text, as one struct."""
    text = structured(normalised(F.col("text")))
    facts = with_details(document_facts(docs.select("doc_id", text.alias("text"))))
    numbers = F.array_sort(F.map_keys("sections"))
    first = lambda c: F.try_element_at(F.col(c), F.lit(1))
    section = lambda n, *fields: F.when(F.map_contains_key("sections", F.lit(n)), F.struct(*fields)).alias(f"section_{n}")
    codes = ("hazard_codes", "precautionary_codes", "signal_word")
    record = F.struct(
        F.length("text").alias("character_count"),
        F.size("sections").alias("section_count"),
        numbers.alias("section_numbers"),
        section(1, "product_name", "manufacturer", F.col("product_cas").alias("cas_numbers"), F.col("product_ec").alias("ec_number"), F.col("product_reach").alias("reach_number"), "product_code", F.nullif("ufi", F.lit("")).alias("ufi")),
        section(2, *codes, F.col("explicit_ghs").alias("ghs_codes")),
        section(3, F.col("component_cas").alias("cas_numbers"), F.col("component_ecs").alias("ec_numbers"), F.col("component_reach").alias("reach_numbers"), "component_names", F.col("component_ec").alias("ec_number"), first("component_reach").alias("reach_number")),
        F.when(F.map_contains_key("sections", F.lit(7)), F.col("handling")).alias("section_7"),
        F.when(F.map_contains_key("sections", F.lit(8)), F.col("protection")).alias("section_8"),
        F.when(F.map_contains_key("sections", F.lit(9)), F.col("properties")).alias("section_9"),
        F.struct("preparation_date", "revision_date", "version").alias("revision"),
        F.struct((F.col("document_type") == "SDS").alias("is_probable_sds"), "sds_confidence", F.col("ghs_codes").alias("ghs_codes"), (F.col("processing_status") == "needs_review").alias("needs_review"), "review_reasons").alias("ingestion_summary"),
    )
    return facts.select("doc_id", record.alias("record"))
