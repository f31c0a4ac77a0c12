"""The tables of parsed sheets: child rows of each document, upload, reprocessing and its preview.

A store is a folder with a Parquet table for each name in ``TABLES`` and a log of commits (``operators.commits``).
Uploads, reprocessing and chemicals made by hand are batches of named writers, so none overwrites another's. A document
belongs to the first commit that brought its id and its content; its rows are those of the last commit of that content.
So two writers that bring the same content at once leave one document, and a second text under a known id leaves the
first alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwright.operators.commits import Batch, Commit, every_commit, live, remove_unread, rows_of
from sheetwright.operators.facts import document_facts, with_details
from sheetwright.operators.relational import matched_chemicals, replace_refusal

TABLES = ("chemicals", "identifiers", "sections", "hazard_codes", "precautionary_codes", "ghs_codes", "storage_info", "ppe_info", "physical_properties", "documents")
#: Columns of a document.
DOCUMENT = ["doc_id", "file_hash", "chemical_id", "document_type", "product_name", "manufacturer", "product_code", "ufi", "signal_word", "revision_date", "preparation_date", "version", "sds_confidence", "classification_status", "processing_status", "review_reasons"]
#: Values that a preview compares.
COMPARED = ["product_name", "manufacturer", "product_code", "ufi", "signal_word", "revision_date", "preparation_date", "version", "processing_status"]


def child_arrays() -> dict[str, Column]:
    """For each child table the rows of one parsed document (``with_details``) as an array of structs; a document has a code once."""
    one = lambda values, name="code": F.transform(F.array_distinct(values), lambda v: F.struct(v.alias(name)))
    kinds = [("UFI", F.split("ufi", "; ")), ("CAS", F.col("component_cas")), ("EC", F.array("component_ec")), ("REACH", F.col("component_reach")), ("PRODUCT_CODE", F.array("product_code"))]
    typed = lambda kind: (lambda v: F.struct(F.lit(kind).alias("identifier_type"), v.alias("identifier_value")))
    pairs = F.flatten(F.array(*[F.transform(values, typed(kind)) for kind, values in kinds]))
    of_section = lambda n, *columns: F.when(F.map_contains_key("sections", F.lit(n)), F.array(F.struct(*columns)))
    return {
        "identifiers": F.filter(F.array_distinct(pairs), lambda i: i["identifier_value"] != ""),
        "sections": F.transform(F.map_entries("sections"), lambda e: F.struct(e["key"].alias("section_number"), e["value"].alias("content"))),
        "hazard_codes": one(F.col("hazard_codes")),
        "precautionary_codes": one(F.col("precautionary_codes")),
        "ghs_codes": one(F.col("ghs_codes")),
        "storage_info": of_section(7, *[f"handling.{c}" for c in ("handling_precautions", "storage_conditions", "incompatible_materials", "fire_explosion_precautions", "specific_end_use")]),
        "ppe_info": of_section(8, "protection.*"),
        "physical_properties": of_section(9, "properties.*"),
    }


def child_rows(facts: DataFrame) -> dict[str, DataFrame]:
    """The child tables of parsed documents, keyed by doc_id.

    Arrays are exploded in the outer form: the inner one makes the optimizer add a filter that computes them again.
    """
    rows = lambda found: facts.select("doc_id", F.explode_outer(found).alias("row")).where("row is not null").select("doc_id", "row.*")
    return {name: rows(found) for name, found in child_arrays().items()}


def new_id(*values: Column) -> Column:
    """A positive id that the values decide, so that no counter has to be shared."""
    return F.xxhash64(*values).bitwiseAND(F.lit((1 << 62) - 1))


def with_chemicals(facts: DataFrame, chemicals: DataFrame, ufis: DataFrame) -> DataFrame:
    """``facts`` with the chemical that is meant, or the id of one that is to be made, and ``is_new``.

    Sheets of one new name and maker share a chemical; a sheet without a name gets one of its own.
    """
    key = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    found = matched_chemicals(facts, chemicals, ufis)
    own = F.when(key("product_name") == "", new_id(F.lit("sheet"), "file_hash")).otherwise(new_id(F.lit("name"), key("product_name"), key("manufacturer")))
    return found.withColumn("is_new", F.col("chemical_id").isNull()).withColumn("chemical_id", F.coalesce("chemical_id", own))


def _owners(documents: DataFrame) -> DataFrame:
    """(doc_id, place): the documents that count, with the commit whose rows are theirs."""
    versions = documents.groupBy("doc_id", "file_hash").agg(F.min("place").alias("since"), F.max("place").alias("place"))
    named = versions.groupBy("doc_id").agg(F.min_by(F.struct("file_hash", "since", "place"), F.struct("since", "file_hash")).alias("v")).select("doc_id", "v.*")
    return named.groupBy("file_hash").agg(F.min_by(F.struct("doc_id", "place"), F.struct("since", "doc_id")).alias("d")).select("d.*")


def _counted(spark: SparkSession, root: str, name: str, commits: list[Commit], schema: str | None = None) -> DataFrame:
    """The rows of a table that count after ``commits``."""
    rows = rows_of(spark, root, name, commits, schema)
    if name == "chemicals":
        return rows.groupBy("id").agg(F.min_by(F.struct("product_name", "manufacturer", "internal_code"), "place").alias("c")).select("id", "c.*")
    owners = _owners(rows_of(spark, root, "documents", commits, "doc_id long, file_hash string"))
    return rows.join(owners, ["doc_id", "place"], "left_semi").drop("place")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The rows of a table that count: of each document those of its last commit; chemicals once each, as first made."""
    return _counted(spark, root, name, live(every_commit(spark, root)))


def outcomes(spark: SparkSession, root: str, writer: str, batch: int) -> DataFrame:
    """What became of each document of a committed batch: (doc_id, file_hash, outcome)."""
    found = [c for c in every_commit(spark, root) if (c.writer, c.batch) == (writer, batch)]
    return rows_of(spark, root, "outcomes", found, "doc_id long, file_hash string, outcome string").drop("place")


def create_chemicals(spark: SparkSession, root: str, rows: DataFrame, batch: int, writer: str = "by_hand") -> None:
    """Add chemicals (product_name, manufacturer, internal_code) by hand. A chemical that is there stays as it is."""
    attempt = Batch(spark, root, writer, batch)
    if attempt.done is None:
        made = rows.select(new_id(F.lit("made"), "product_name", "manufacturer", "internal_code").alias("id"), "product_name", "manufacturer", "internal_code").distinct()
        attempt.write("chemicals", made)
        attempt.commit()


def _parsed(docs: DataFrame) -> DataFrame:
    """Facts and details of ``docs`` (doc_id, text and what else is there), without the text."""
    return with_details(document_facts(docs)).drop("text")


def _write_parsed(parsed: DataFrame, attempt: Batch) -> None:
    for name, rows in child_rows(parsed).items():
        attempt.write(name, rows)
    attempt.write("documents", parsed.select(*DOCUMENT, F.size("sections").alias("section_count")))


def upload(docs: DataFrame, root: str, batch: int, writer: str = "upload") -> DataFrame:
    """Parse ``docs`` (doc_id, text) and add those whose text the store hasn't: match or make chemicals, child rows, documents.

    Returns (doc_id, file_hash, outcome) of each different (doc_id, text): ``stored``; ``known_content`` where the store
    or a smaller doc_id of the batch has the text; ``id_taken`` where another text has the id (of two in a batch the
    one with the smaller hash is taken); ``id_missing`` for a null id. A batch that is committed already is not read
    again, its outcomes are returned. Parsed rows are written once, so that no sheet is read twice. Null texts are
    sheets like others.
    """
    spark = docs.sparkSession
    attempt = Batch(spark, root, writer, batch)
    if attempt.done is not None:
        return outcomes(spark, root, writer, batch)
    earlier = lambda name, schema: _counted(spark, root, name, attempt.before, schema)
    hashed = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("file_hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    stored = earlier("documents", "doc_id long, file_hash string").select("doc_id", "file_hash")
    keys = hashed.groupBy("doc_id", "file_hash").agg(F.lit(1).alias("one")).drop("one")
    keys = keys.join(stored.select("file_hash", F.lit(True).alias("content")).distinct(), "file_hash", "left").join(stored.select("doc_id", F.lit(True).alias("named")).distinct(), "doc_id", "left")
    judged = attempt.write("_keys", keys)
    fresh = judged.where("content is null and named is null and doc_id is not null")
    taken = fresh.groupBy("doc_id").agg(F.min("file_hash").alias("file_hash")).groupBy("file_hash").agg(F.min("doc_id").alias("doc_id"))
    if taken.isEmpty():
        said = F.when(F.col("doc_id").isNull(), "id_missing").when(F.col("content"), "known_content").otherwise("id_taken")
        attempt.write("outcomes", judged.select("doc_id", "file_hash", said.alias("outcome")))
        attempt.commit()
        return outcomes(spark, root, writer, batch)
    facts = attempt.write("_parsed", _parsed(hashed.join(taken, ["doc_id", "file_hash"], "left_semi").dropDuplicates(["doc_id"])))

    numbers = earlier("identifiers", "doc_id long, identifier_type string, identifier_value string").where("identifier_type = 'UFI'")
    owners = earlier("documents", "doc_id long, file_hash string, chemical_id long").select("doc_id", "chemical_id")
    known = earlier("chemicals", "id long, product_name string, manufacturer string, internal_code string")
    matched = with_chemicals(facts, known, numbers.join(owners, "doc_id").select("chemical_id", "identifier_value").distinct())
    made = matched.where("is_new").groupBy("chemical_id").agg(F.min_by(F.struct("product_name", "manufacturer", F.col("product_code").alias("internal_code")), "doc_id").alias("c"))
    attempt.write("chemicals", made.select(F.col("chemical_id").alias("id"), "c.*"))
    _write_parsed(matched, attempt)
    won = facts.select("doc_id", "file_hash", F.lit(True).alias("won"))
    content_won = facts.select("file_hash", F.lit(True).alias("content_won"))
    said = F.when(F.col("doc_id").isNull(), "id_missing").when(F.col("won"), "stored").when(F.col("content") | F.col("content_won"), "known_content").otherwise("id_taken")
    attempt.write("outcomes", judged.join(won, ["doc_id", "file_hash"], "left").join(content_won, "file_hash", "left").select("doc_id", "file_hash", said.alias("outcome")))
    attempt.commit()
    return outcomes(spark, root, writer, batch)


def compact(spark: SparkSession, root: str, batch: int, writer: str = "compaction") -> None:
    """Put the rows that count into one batch, which stands in for all that it has read.

    Commits that others make meanwhile stay as they are: the new batch has the number of the last that it has read.
    """
    attempt = Batch(spark, root, writer, batch)
    if attempt.done is not None or len(attempt.before) < 2:
        return
    for name in TABLES:
        if any(name in c.tables for c in attempt.before):
            attempt.write(name, _counted(spark, root, name, attempt.before))
    attempt.commit(replaces=[c.name for c in attempt.before], number=max(c.number for c in attempt.before))


def clean_up(spark: SparkSession, root: str) -> int:
    """Delete what broken attempts and compacted batches left; for quiet times. Outcomes of compacted batches go too."""
    return remove_unread(spark, root, [*TABLES, "outcomes", "_keys", "_parsed", "_judged"])


def preview(docs: DataFrame, root: str) -> DataFrame:
    """What parsing ``docs`` (doc_id, text) again would change: doc_id, field, stored, parsed, refusal. Nothing is written.

    A row for each compared value that differs, and one row with null values for a document without changes or one
    that the store hasn't (refusal ``unknown_document``).
    """
    facts = document_facts(docs.select("doc_id", "text"))
    return differences(facts, read_table(docs.sparkSession, root, "documents"))


def differences(facts: DataFrame, stored: DataFrame) -> DataFrame:
    """The rows of ``preview`` for parsed facts and stored documents."""
    text = lambda side, c: F.col(f"{side}.{c}").cast("string")
    both = facts.alias("new").join(stored.alias("old"), "doc_id", "left")
    changed = F.filter(F.array(*[F.struct(F.lit(c).alias("field"), text("old", c).alias("stored"), text("new", c).alias("parsed")) for c in COMPARED]), lambda x: ~x["stored"].eqNullSafe(x["parsed"]))
    refusal = F.when(F.col("old.file_hash").isNull(), "unknown_document").otherwise(replace_refusal(F.col("new.product_name"), F.col("old.ufi"), F.col("new.ufi"), text("new", "revision_date")))
    rows = both.select("doc_id", refusal.alias("refusal"), F.when(F.col("old.file_hash").isNotNull(), changed).alias("changed"))
    return rows.select("doc_id", "refusal", F.explode_outer("changed").alias("c")).select("doc_id", "c.field", "c.stored", "c.parsed", "refusal")


def reprocess(docs: DataFrame, root: str, batch: int, writer: str = "reprocess") -> DataFrame:
    """Parse ``docs`` (doc_id, text) again and replace what was derived; returns (doc_id, file_hash, outcome).

    Ids, hashes and chemicals stay. The outcome is ``replaced``, or why not: a document without a name, with other UFIs
    or a broken date is refused and keeps its rows, as does one that the store hasn't. Of several texts of one id the
    smallest is read. A batch that is committed already isn't read again.
    """
    spark = docs.sparkSession
    attempt = Batch(spark, root, writer, batch)
    if attempt.done is not None:
        return outcomes(spark, root, writer, batch)
    once = docs.groupBy("doc_id").agg(F.min(F.col("text").cast("string")).alias("text"))
    facts = attempt.write("_parsed", _parsed(once))
    stored = _counted(spark, root, "documents", attempt.before, "doc_id long, file_hash string, chemical_id long, ufi string")
    both = facts.join(stored.select("doc_id", "file_hash", "chemical_id", F.col("ufi").alias("old_ufi")), "doc_id", "left")
    refusal = F.when(F.col("file_hash").isNull(), "unknown_document").otherwise(replace_refusal(F.col("product_name"), F.col("old_ufi"), F.col("ufi"), F.col("revision_date").cast("string")))
    judged = attempt.write("_judged", both.withColumn("refusal", refusal))
    _write_parsed(judged.where("refusal is null"), attempt)
    attempt.write("outcomes", judged.select("doc_id", "file_hash", F.coalesce("refusal", F.lit("replaced")).alias("outcome")))
    attempt.commit()
    return outcomes(spark, root, writer, batch)
