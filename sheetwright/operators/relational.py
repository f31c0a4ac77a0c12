"""Relational operators over chemicals, documents and their child tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetwright.functions.dates import effective_date, version_key
from sheetwright.functions.text import unused


def deduplicated_by_hash(docs: DataFrame, content: Column, doc_id: str = "doc_id") -> DataFrame:
    """(file_hash, doc_id, copies): the first document of each content."""
    return docs.select(F.sha2(content, 256).alias("file_hash"), F.col(doc_id).alias("doc_id")).groupBy("file_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def current_revisions(docs: DataFrame) -> DataFrame:
    """(chemical_id, current_id): the document that is current after all uploads, in the order of upload.

    The first document is current. A later one takes its place if both have a date and its own is later, or
    the dates are equal, both have a version and its own is higher; so a first document without a date stays.
    This fold has a closed form in one aggregation that combines before the shuffle, whatever a chemical's number
    of documents: a dated first document gives way to the first of the latest date, and that one, if it has a
    version, to the highest version of that date.
    """
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), "uploaded_at") if dict(docs.dtypes)["uploaded_at"] == "timestamp_ntz" else F.unix_micros(F.col("uploaded_at").cast("timestamp"))
    rows = docs.select("chemical_id", "id", F.coalesce(micros, F.lit(-(1 << 62))).alias("at"), effective_date(F.col("revision_date"), F.col("preparation_date")).alias("day"), version_key(F.col("version")).alias("key"))
    early = (-F.col("at"), -F.col("id").cast("long"))  # the greatest of these is the earliest upload
    out = rows.groupBy("chemical_id").agg(
        F.min_by(F.struct("id", "day"), F.struct("at", "id")).alias("first"),
        F.max_by(F.struct("id", "key"), F.when(F.col("day").isNotNull(), F.struct("day", *early))).alias("lead"),
        F.max_by("id", F.when(F.col("day").isNotNull() & F.col("key").isNotNull(), F.struct("day", "key", *early))).alias("highest"),
    )
    current = F.when(F.col("first.day").isNull(), F.col("first.id")).when(F.col("lead.key").isNull(), F.col("lead.id")).otherwise(F.col("highest"))
    return out.select("chemical_id", current.alias("current_id"))


def _place_in_history() -> Column:
    """What a chemical's history is sorted by, upwards: current first, then by date, upload and id, latest first."""
    late = F.lit((1 << 63) - 1)
    micros = F.unix_micros(F.col("uploaded_at").cast("timestamp"))
    return F.struct(
        F.when(F.col("is_current"), 0).otherwise(1).alias("current"),
        F.coalesce(-F.unix_date("revision_date").cast("long"), late).alias("day"),
        F.coalesce(-micros, late).alias("at"),
        (-F.col("id").cast("long")).alias("id"),
    )


#: Documents of one cell of a hot chemical, about: larger chemicals get more cells.
CELL_ROWS = 200_000


def history(docs: DataFrame, hot: int = 500_000, cells: int = 64) -> DataFrame:
    """``docs`` with ``position`` within a chemical's history: current first, then by date and upload, latest first.

    A chemical with more than ``hot`` documents is ranked in two phases: quantiles of a sample of its documents (those
    with certain hashes, some 50 for each cell) part it into cells, counts of the cells give offsets, and each cell is
    numbered on its own. There are ``cells`` of them, and more where they would hold over ``CELL_ROWS`` documents. What
    hot chemicals are looked up in (a row for each, or for each cell) is broadcast, since a join by chemical would bring all
    documents of one into one task. Which cells there are has no influence on positions. Documents without a chemical are numbered like one chemical.
    """
    names = unused(docs, 5)
    key, cell, bounds, count, offset = map(F.col, names)
    rows = docs.withColumn(names[0], _place_in_history()).withColumn("chemical_id", F.col("chemical_id"))
    many = rows.groupBy("chemical_id").agg(F.count("*").alias(names[3])).where(count > hot).where("chemical_id is not null")
    many = many.withColumn(names[1], F.greatest(F.lit(cells), F.ceil(count / CELL_ROWS)).cast("int"))
    sample = rows.select("chemical_id", names[0]).join(F.broadcast(many), "chemical_id").where(F.pmod(F.xxhash64(key["id"]), F.greatest(F.lit(1), F.floor(count / (50 * cell)))) == 0)
    keys = sample.groupBy("chemical_id").agg(F.sort_array(F.collect_list(key)).alias("keys"), F.first(cell).alias(names[1]))
    cuts = F.when(cell > 1, F.transform(F.sequence(F.lit(1), cell - 1), lambda i: F.element_at("keys", F.floor(i * F.size("keys") / cell).cast("int") + 1)))
    placed = rows.join(F.broadcast(keys.select("chemical_id", cuts.alias(names[2]))), "chemical_id", "left")
    placed = placed.withColumn(names[1], F.when(bounds.isNull(), 0).otherwise(F.size(F.filter(bounds, lambda b: b <= key)))).drop(names[2])
    counts = placed.where("chemical_id is not null").join(F.broadcast(many.select("chemical_id")), "chemical_id", "left_semi").groupBy("chemical_id", names[1]).agg(F.count("*").alias(names[3]))
    before = Window.partitionBy("chemical_id").orderBy(names[1]).rowsBetween(Window.unboundedPreceding, -1)  # as many rows as cells
    offsets = counts.select("chemical_id", names[1], F.coalesce(F.sum(count).over(before), F.lit(0)).alias(names[4]))
    numbered = placed.withColumn("position", F.row_number().over(Window.partitionBy("chemical_id", names[1]).orderBy(names[0])))
    out = numbered.join(F.broadcast(offsets), ["chemical_id", names[1]], "left").withColumn("position", F.col("position") + F.coalesce(offset, F.lit(0)))
    return out.select(*docs.columns, F.col("position").cast("long").alias("position"))


def summaries(chemicals: DataFrame, docs: DataFrame) -> DataFrame:
    """Each chemical with its number of documents, those that need review, and its current and latest document."""
    per = docs.groupBy("chemical_id").agg(
        F.count("*").alias("total_documents"),
        F.count_if(F.col("processing_status") == "needs_review").alias("needs_review_count"),
        F.max_by("id", F.struct("uploaded_at", "id")).alias("latest_id"),
    )
    out = chemicals.join(per, chemicals["id"] == per["chemical_id"], "left").join(current_revisions(docs), ["chemical_id"], "left")
    return out.select(chemicals["*"], F.coalesce("total_documents", F.lit(0)).alias("total_documents"), F.coalesce("needs_review_count", F.lit(0)).alias("needs_review_count"), "latest_id", "current_id")


def details(summary: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, current_id, sds): each chemical with its documents (id, processing_status) by id; null where it has none.

    The nested form holds a chemical's documents in one value, as an answer about one chemical needs it; for all
    chemicals at once, the rows that it is made of are the better form.
    """
    nested = docs.groupBy(F.col("chemical_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("id", "processing_status"))).alias("sds"))
    return summary.join(nested, "id", "left").select("id", "current_id", "sds")


def code_lists(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, values): the trimmed, distinct values of each key, sorted; blank and null ones are left out."""
    tidy = rows.select(key, F.trim(F.col(value)).alias("value")).where("value <> ''").distinct()
    return tidy.groupBy(key).agg(F.array_sort(F.collect_list("value")).alias("values"))


def identifier_of(identifiers: DataFrame, kind: str, blank: str = "—") -> DataFrame:
    """(chemical_id, identifier): the identifier of a kind with the smallest id, whatever the case; blanks as a dash."""
    rows = identifiers.where(F.upper(F.trim("identifier_type")) == kind.upper())
    return rows.groupBy("chemical_id").agg(F.min_by("identifier_value", "id").alias("found")).select("chemical_id", F.coalesce(F.nullif(F.trim("found"), F.lit("")), F.lit(blank)).alias("identifier"))


#: The ways in which a chemical is recognised, the surest first.
WAYS = ("ufi", "name_maker", "code", "name")


def identifiers_of(identifiers: DataFrame, kind: str) -> DataFrame:
    """(chemical_id, values): all identifiers of exactly this kind, trimmed, distinct, sorted; blank ones are left out."""
    return code_lists(identifiers.where(F.col("identifier_type") == kind), "chemical_id", "identifier_value")


def matched_chemicals(parsed: DataFrame, chemicals: DataFrame, ufis: DataFrame) -> DataFrame:
    """``parsed`` with the chemical that is meant: by UFI, by name and maker, by code and maker, or by name.

    The first way that finds one decides; of several the smallest id is taken. Comparison ignores case and
    surrounding blanks; missing values match nothing.

    All ways are looked up by one join in long form, (way, key): different probes once each, so that values which most
    sheets share are not met again and again, and the surest way that was found comes back by an aggregation.
    """
    key = lambda *cols: F.when(F.concat(*cols).isNotNull() & (F.concat(*[F.trim(c) for c in cols]) != ""), F.concat_ws("\x1f", *[F.lower(F.trim(c)) for c in cols]))
    ways = lambda *keys: F.filter(F.array(*[F.struct(F.lit(i).alias("way"), k.alias("key")) for i, k in enumerate(keys)]), lambda w: w["key"].isNotNull())
    name, maker, code = F.col("product_name"), F.col("manufacturer"), F.col("internal_code")
    known = chemicals.select("id", F.explode(ways(F.lit(None).cast("string"), key(name, maker), key(code, maker), key(name))).alias("w")).select("id", "w.*")
    known = known.unionByName(ufis.select(F.col("chemical_id").alias("id"), F.explode(ways(key(F.col("identifier_value")))).alias("w")).select("id", "w.*"))
    known = known.groupBy("way", "key").agg(F.min("id").alias("id"))
    probe, found = unused(parsed, 2)
    asked = parsed.withColumn(probe, ways(key(F.col("ufi")), key(name, maker), key(F.col("product_code"), maker), key(name)))
    probes = asked.where(F.size(probe) > 0).select(probe).distinct().select(probe, F.explode(probe).alias("w")).select(probe, "w.*")
    best = probes.join(known, ["way", "key"]).groupBy(probe).agg(F.min(F.struct("way", "id")).alias(found))
    out = asked.join(best, probe, "left")
    way = F.when(F.col(f"{found}.id").isNotNull(), F.element_at(F.array(*map(F.lit, WAYS)), F.col(f"{found}.way") + 1))
    return out.withColumn("chemical_id", F.col(f"{found}.id")).withColumn("matched_by", way).drop(probe, found).select(*[c for c in parsed.columns if c not in ("chemical_id", "matched_by")], "chemical_id", "matched_by")


def missing_rows(wanted: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct rows of ``wanted`` whose keys ``present`` lacks: what an insert-if-absent appends."""
    return wanted.dropDuplicates(keys).join(present.select(keys), keys, "left_anti")


def replaced_rows(present: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """``present`` with all rows of the keys in ``fresh`` replaced by those of ``fresh``."""
    return present.join(fresh.select(key).distinct(), key, "left_anti").select(present.columns).unionByName(fresh)


def ufi_set(value: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ";"), lambda x: F.upper(F.trim(x))), lambda x: x != ""))


def replace_refusal(name: Column, old_ufi: Column, new_ufi: Column, raw_date: Column) -> Column:
    """Why a stored document must not be replaced by a new parse, or null."""
    old, new = ufi_set(old_ufi), ufi_set(new_ufi)
    clash = (F.size(old) > 0) & (F.size(new) > 0) & ~F.arrays_overlap(old, new)
    bad = (F.coalesce(F.trim(raw_date), F.lit("")) != "") & F.try_to_date(F.substring(F.trim(raw_date), 1, 10), "yyyy-MM-dd").isNull()
    return F.when(F.coalesce(F.trim(name), F.lit("")) == "", "product_name_missing").when(clash, "ufi_mismatch").when(bad, "date_invalid")


def backfilled(stored: DataFrame, parsed: DataFrame, key: str, fill: list[str], sets: list[str], enough: int = 16) -> DataFrame:
    """Changes that a safe update would make: nulls filled, missing codes added, status raised; nothing overwritten.

    Columns: key, each of ``fill`` as it becomes, each of ``sets`` as the codes to add, changes, outcome.
    """
    new = parsed.select(key, *[F.col(c).alias(f"_{c}") for c in [*fill, *sets]], F.col("section_count").alias("_count"))
    out = stored.join(new, key, "left")
    changes = sum((F.when(F.col(c).isNull() & F.col(f"_{c}").isNotNull(), 1).otherwise(0) for c in fill), F.lit(0))
    added = {c: F.array_except(F.coalesce(f"_{c}", F.array().cast("array<string>")), F.coalesce(c, F.array().cast("array<string>"))) for c in sets}
    for c in sets:
        changes = changes + F.size(added[c])
    raised = (F.col("processing_status") == "sections_incomplete") & (F.col("_count") == enough)
    changes = changes + F.when(raised, 1).otherwise(0)
    out = out.withColumn("changes", changes)
    outcome = F.when(F.col("_count").isNull(), "not_parsed").when(F.col("changes") > 0, "changed").otherwise("unchanged")
    return out.select(key, *[F.coalesce(c, f"_{c}").alias(c) for c in fill], *[added[c].alias(c) for c in sets], F.when(raised, "sections_extracted").otherwise(F.col("processing_status")).alias("processing_status"), "changes", outcome.alias("outcome"))
