"""Queries of the relational operators and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetwright.functions.dates import version_key
from sheetwright.operators import relational as rel
from sheetwright.operators import reports, search
from sheetwright.plans.views import CHEMICALS_SQL, DOCUMENTS_SQL, chemicals, documents, table

_KEY = "list_transform(string_split(version, '.'), lambda x: CAST(x AS INTEGER))"
#: The fold of current revisions, one upload after another.
CURRENT_SQL = f"""
    ranked AS (SELECT *, coalesce(revision_date, preparation_date) AS day, CASE WHEN version IS NOT NULL THEN {_KEY} END AS vkey,
                      row_number() OVER (PARTITION BY chemical_id ORDER BY uploaded_at, id) AS rn FROM documents_),
    fold AS (SELECT chemical_id, rn, id AS current_id, day, vkey FROM ranked WHERE rn = 1
             UNION ALL
             SELECT r.chemical_id, r.rn,
                    CASE WHEN r.day > f.day OR (r.day = f.day AND r.vkey > f.vkey) THEN r.id ELSE f.current_id END,
                    CASE WHEN r.day > f.day OR (r.day = f.day AND r.vkey > f.vkey) THEN r.day ELSE f.day END,
                    CASE WHEN r.day > f.day OR (r.day = f.day AND r.vkey > f.vkey) THEN r.vkey ELSE f.vkey END
             FROM fold f JOIN ranked r ON r.chemical_id = f.chemical_id AND r.rn = f.rn + 1),
    current_ AS (SELECT chemical_id, arg_max(current_id, rn) AS current_id FROM fold GROUP BY chemical_id)"""
SUMMARY_SQL = f"""WITH RECURSIVE {CHEMICALS_SQL}, {DOCUMENTS_SQL}, {CURRENT_SQL},
    per AS (SELECT chemical_id, count(*) AS total_documents, count(*) FILTER (processing_status = 'needs_review') AS needs_review_count
            FROM (SELECT * FROM documents_ ORDER BY uploaded_at, id) GROUP BY chemical_id),
    latest AS (SELECT chemical_id, id AS latest_id FROM documents_ QUALIFY row_number() OVER (PARTITION BY chemical_id ORDER BY uploaded_at DESC, id DESC) = 1),
    summary AS (SELECT c.*, coalesce(total_documents, 0) AS total_documents, coalesce(needs_review_count, 0) AS needs_review_count, l.latest_id, current_id
                FROM chemicals c LEFT JOIN per ON per.chemical_id = c.id LEFT JOIN latest l ON l.chemical_id = c.id LEFT JOIN current_ x ON x.chemical_id = c.id)"""


def _summary(spark, d):
    return rel.summaries(chemicals(spark, d), documents(spark, d))


def _history(spark, d):
    docs = documents(spark, d)
    now = rel.current_revisions(docs).select(F.col("current_id").alias("id"), F.lit(True).alias("is_current"))
    marked = docs.join(now, "id", "left").withColumn("is_current", F.coalesce("is_current", F.lit(False)))
    return rel.history(marked).select("chemical_id", "id", "is_current", "position")


def _parsed(spark, d):
    """Names, makers and codes to be matched: some exact, some in another case, some unknown."""
    rows = table(spark, d, "supplier").selectExpr("s_suppkey as doc_id", "s_nationkey as nation")
    return rows.selectExpr(
        "doc_id",
        "case when doc_id % 4 = 0 then concat('UFI-', doc_id) end as ufi",
        "case when doc_id % 5 < 3 then upper(concat('Customer#', lpad(doc_id, 9, '0'))) else 'Unknown' end as product_name",
        "concat(' maker ', doc_id % 25) as manufacturer",
        "concat('c', doc_id % 500) as product_code",
    )


def _matched(spark, d):
    chem = chemicals(spark, d)
    ufis = chem.where("id % 8 = 0").selectExpr("id as chemical_id", "concat('ufi-', id) as identifier_value")
    return rel.matched_chemicals(_parsed(spark, d), chem, ufis).select("doc_id", "chemical_id", "matched_by")


def _missing(spark, d):
    lines = table(spark, d, "lineitem")
    wanted = lines.selectExpr("l_orderkey as doc_id", "concat('H3', lpad(l_partkey % 100, 2, '0')) as code")
    present = lines.where("l_linenumber = 1").selectExpr("l_orderkey as doc_id", "concat('H3', lpad(l_partkey % 100, 2, '0')) as code").distinct()
    return rel.missing_rows(wanted, present, ["doc_id", "code"])


def _replaced(spark, d):
    lines = table(spark, d, "lineitem")
    old = lines.where("l_linenumber <= 2").selectExpr("l_orderkey as doc_id", "concat('P', l_partkey % 500) as code")
    new = lines.where("l_orderkey % 3 = 0 and l_linenumber = 3").selectExpr("l_orderkey as doc_id", "concat('P', l_suppkey % 500) as code")
    return rel.replaced_rows(old, new, "doc_id").groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("code").alias("least"), F.max("code").alias("most"))


def _refusal(spark, d):
    rows = table(spark, d, "orders").selectExpr(
        "o_orderkey as doc_id",
        "case when o_orderkey % 10 = 0 then ' ' else 'Name' end as name",
        "case when o_orderkey % 3 = 0 then '' else concat('A', o_orderkey % 4, '; b', o_orderkey % 5) end as old_ufi",
        "case when o_orderkey % 4 = 1 then null else concat('a', o_orderkey % 6, ';B', o_orderkey % 7) end as new_ufi",
        "case o_orderkey % 3 when 0 then '2021-02-30' when 1 then '2021-02-28T10:00' else '' end as raw_date",
    )
    return rows.select("doc_id", rel.replace_refusal(F.col("name"), F.col("old_ufi"), F.col("new_ufi"), F.col("raw_date")).alias("reason"))


def _backfill(spark, d):
    docs = documents(spark, d)
    stored = docs.selectExpr("id", "revision_date", "version", "processing_status", "array(concat('H', id % 4), concat('H', id % 5)) as codes")
    parsed = docs.where("id % 6 <> 0").selectExpr("id", "date'2020-01-01' as revision_date", "'9.9' as version", "array(concat('H', id % 3), 'H9') as codes", "case when id % 2 = 0 then 16 else 14 end as section_count")
    return rel.backfilled(stored, parsed, "id", ["revision_date", "version"], ["codes"])


_BACKFILL_SQL = f"""WITH {DOCUMENTS_SQL},
    p AS (SELECT id, id % 6 <> 0 AS parsed, revision_date, version, processing_status,
                 list_filter([concat('H', id % 3), 'H9'], lambda x: x <> concat('H', id % 4) AND x <> concat('H', id % 5)) AS extra,
                 id % 6 <> 0 AND id % 2 = 0 AND processing_status = 'sections_incomplete' AS raised FROM documents_),
    b AS (SELECT id, CASE WHEN parsed THEN coalesce(revision_date, DATE '2020-01-01') ELSE revision_date END AS revision_date,
                 CASE WHEN parsed THEN coalesce(version, '9.9') ELSE version END AS version, CASE WHEN parsed THEN extra ELSE [] END AS codes,
                 CASE WHEN raised THEN 'sections_extracted' ELSE processing_status END AS processing_status,
                 CASE WHEN parsed THEN (revision_date IS NULL)::INT + (version IS NULL)::INT + len(extra) + raised::INT ELSE 0 END AS changes, parsed FROM p)"""


def _search(spark, d):
    named = chemicals(spark, d).join(table(spark, d, "customer").selectExpr("c_custkey as id", "c_mktsegment as segment"), "id")
    return reports.search(named, "MAKER 1", ["product_name", "manufacturer", "internal_code", "segment"]).select("id", "product_name", "manufacturer")


#: Makers in the order of the Turkish alphabet.
_TURKISH = ["cam", "Çam", "dağ", "Demir", "Ilgaz", "ışık", "inci", "İzmir", "kum", "oda", "Öz", "su", "Şeker", "un", "Üzüm", "zar"]


def _report(spark, d):
    """Chemicals of makers with Turkish letters: some makers have as many chemicals as others, some chemicals no maker."""
    maker = F.element_at(F.array(*map(F.lit, _TURKISH)), (F.col("id") * 7 % 23 % 16 + 1).cast("int"))
    rows = chemicals(spark, d).withColumn("manufacturer", F.when(F.col("id") % 29 == 0, " ").when(F.col("id") % 31 == 0, None).otherwise(maker))
    return reports.manufacturer_report(rows)


def _hot_history(spark, d):
    """History of documents of which a third belong to one chemical."""
    docs = documents(spark, d).selectExpr("id", "if(id % 3 = 0, 0, chemical_id) as chemical_id", "revision_date", "uploaded_at", "id % 11 = 0 as is_current")
    return rel.history(docs, hot=1000, cells=16).select("chemical_id", "id", "position")


def _search_many(spark, d):
    """Terms of each supplier, long, short and unknown, looked up in three fields of all chemicals."""
    terms = table(spark, d, "supplier").selectExpr("case s_suppkey % 4 when 0 then concat(' AKER ', s_suppkey % 25) when 1 then concat('#00000', lpad(s_suppkey, 3, '0')) when 2 then concat('C', s_suppkey % 10) else concat('maker x', s_suppkey) end as term")
    return search.search_terms(chemicals(spark, d), terms, ["product_name", "manufacturer", "internal_code"])


QUERIES = {
    "search_terms": _search_many,
    "history_hot_chemical": _hot_history,
    "manufacturer_report": _report,
    "dedup_by_hash": lambda s, d: rel.deduplicated_by_hash(table(s, d, "documents"), F.col("text")),
    "version_compare": lambda s, d: documents(s, d).select("id", (version_key(F.col("version")) > F.array(F.lit(2), F.lit(5))).alias("newer")),
    "effective_date": lambda s, d: documents(s, d).select("id", F.coalesce("revision_date", "preparation_date").alias("day")),
    "current_revision_fold": lambda s, d: rel.current_revisions(documents(s, d)),
    "history_order": _history,
    "chemical_summary": _summary,
    "chemical_detail_nested": lambda s, d: rel.details(_summary(s, d), documents(s, d)).select("id", F.to_json("sds").alias("documents"), "current_id"),
    "entity_match_priority": _matched,
    "codes_insert_missing": _missing,
    "replace_derived": _replaced,
    "reprocess_guard_reason": _refusal,
    "backfill_fill_nulls": _backfill,
    "backfill_totals": lambda s, d: _backfill(s, d).groupBy("outcome").agg(F.count("*").alias("documents"), F.sum("changes").alias("changes")),
    "inventory_totals": lambda s, d: reports.inventory_totals(_summary(s, d)),
    "manufacturer_share": lambda s, d: reports.by_manufacturer(chemicals(s, d)),
    "status_report": lambda s, d: reports.by_status(_summary(s, d), documents(s, d)),
    "recent_top10": lambda s, d: reports.recent(_summary(s, d), documents(s, d)),
    "attention_list": lambda s, d: reports.needs_attention(_summary(s, d)).select("id", "needs_review_count", "current_id"),
    "review_queue": lambda s, d: reports.review_queue(_summary(s, d), documents(s, d)).select("chemical_id", "id", "product_name", "manufacturer"),
    "search_any_field": _search,
    "eligible_filter": lambda s, d: reports.eligible(_summary(s, d)).select("id", "current_id"),
    "chemical_row_status": lambda s, d: reports.row_status(_summary(s, d), documents(s, d)),
    "status_label_map": lambda s, d: documents(s, d).select("id", reports.status_label(F.when(F.col("id") % 9 == 0, "").otherwise(F.col("processing_status"))).alias("label")),
    "props_json_extract": lambda s, d: table(s, d, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k_sum"), F.count("*").alias("events")),
}

ORACLE_SQL = {
    "search_terms": f"""WITH {CHEMICALS_SQL}, t AS (SELECT DISTINCT CASE s_suppkey % 4 WHEN 0 THEN concat(' AKER ', s_suppkey % 25) WHEN 1 THEN concat('#00000', lpad(CAST(s_suppkey AS VARCHAR), 3, '0')) WHEN 2 THEN concat('C', s_suppkey % 10) ELSE concat('maker x', s_suppkey) END AS term FROM supplier)
        SELECT term, id FROM t JOIN chemicals ON contains(lower(product_name), lower(trim(term))) OR contains(lower(manufacturer), lower(trim(term))) OR contains(lower(internal_code), lower(trim(term)))""",
    "history_hot_chemical": f"""WITH {DOCUMENTS_SQL}, h AS (SELECT id, CASE WHEN id % 3 = 0 THEN 0 ELSE chemical_id END AS chemical_id, revision_date, uploaded_at, id % 11 = 0 AS is_current FROM documents_)
        SELECT chemical_id, id, row_number() OVER (PARTITION BY chemical_id ORDER BY is_current DESC, revision_date DESC NULLS LAST, uploaded_at DESC NULLS LAST, id DESC) AS position FROM h""",
    "manufacturer_report": f"""WITH t AS (SELECT unnest({_TURKISH!r}) AS manufacturer, unnest(range({len(_TURKISH)})) AS place UNION ALL SELECT 'Üretici bilgisi yok', 14.5),
        m AS (SELECT CASE WHEN c_custkey % 29 = 0 OR c_custkey % 31 = 0 THEN 'Üretici bilgisi yok' ELSE {_TURKISH!r}[c_custkey * 7 % 23 % 16 + 1] END AS manufacturer FROM customer),
        c AS (SELECT manufacturer, count(*) AS chemicals FROM m GROUP BY 1)
        SELECT row_number() OVER (ORDER BY chemicals DESC, place) AS position, manufacturer, chemicals FROM c JOIN t USING (manufacturer)""",
    "dedup_by_hash": "SELECT sha256(text) AS file_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
    "version_compare": f"WITH {DOCUMENTS_SQL} SELECT id, CASE WHEN version IS NOT NULL THEN {_KEY} > [2, 5] END AS newer FROM documents_",
    "effective_date": f"WITH {DOCUMENTS_SQL} SELECT id, coalesce(revision_date, preparation_date) AS day FROM documents_",
    "current_revision_fold": f"WITH RECURSIVE {DOCUMENTS_SQL}, {CURRENT_SQL} SELECT chemical_id, current_id FROM current_",
    "history_order": f"""WITH RECURSIVE {DOCUMENTS_SQL}, {CURRENT_SQL}, m AS (SELECT d.*, coalesce(d.id = c.current_id, false) AS is_current FROM documents_ d LEFT JOIN current_ c USING (chemical_id))
        SELECT chemical_id, id, is_current, row_number() OVER (PARTITION BY chemical_id ORDER BY is_current DESC, revision_date DESC NULLS LAST, uploaded_at DESC NULLS LAST, id DESC) AS position FROM m""",
    "chemical_summary": f"{SUMMARY_SQL} SELECT * FROM summary",
    "chemical_detail_nested": f"""{SUMMARY_SQL}, n AS (SELECT chemical_id AS id, '[' || string_agg('{{"id":' || id || ',"processing_status":"' || processing_status || '"}}', ',' ORDER BY id) || ']' AS documents FROM documents_ GROUP BY 1)
        SELECT id, documents, current_id FROM summary LEFT JOIN n USING (id)""",
    "entity_match_priority": f"""WITH {CHEMICALS_SQL}, p AS (SELECT s_suppkey AS doc_id, CASE WHEN s_suppkey % 4 = 0 THEN concat('ufi-', s_suppkey) END AS ufi,
               CASE WHEN s_suppkey % 5 < 3 THEN lower(concat('Customer#', lpad(CAST(s_suppkey AS VARCHAR), 9, '0'))) ELSE 'unknown' END AS name, concat('maker ', s_suppkey % 25) AS maker, concat('c', s_suppkey % 500) AS code FROM supplier),
        m AS (SELECT doc_id, (SELECT min(id) FROM chemicals WHERE id % 8 = 0 AND concat('ufi-', id) = ufi) AS m0,
                     (SELECT min(id) FROM chemicals WHERE lower(trim(product_name)) = name AND lower(trim(manufacturer)) = maker) AS m1,
                     (SELECT min(id) FROM chemicals WHERE lower(trim(internal_code)) = code AND lower(trim(manufacturer)) = maker) AS m2,
                     (SELECT min(id) FROM chemicals WHERE lower(trim(product_name)) = name) AS m3 FROM p)
        SELECT doc_id, coalesce(m0, m1, m2, m3) AS chemical_id, CASE WHEN m0 IS NOT NULL THEN 'ufi' WHEN m1 IS NOT NULL THEN 'name_maker' WHEN m2 IS NOT NULL THEN 'code' WHEN m3 IS NOT NULL THEN 'name' END AS matched_by FROM m""",
    "codes_insert_missing": """WITH w AS (SELECT DISTINCT l_orderkey AS doc_id, concat('H3', lpad(CAST(l_partkey % 100 AS VARCHAR), 2, '0')) AS code FROM lineitem)
        SELECT * FROM w EXCEPT SELECT l_orderkey, concat('H3', lpad(CAST(l_partkey % 100 AS VARCHAR), 2, '0')) FROM lineitem WHERE l_linenumber = 1""",
    "replace_derived": """WITH n AS (SELECT l_orderkey AS doc_id, concat('P', l_suppkey % 500) AS code FROM lineitem WHERE l_orderkey % 3 = 0 AND l_linenumber = 3),
        o AS (SELECT l_orderkey AS doc_id, concat('P', l_partkey % 500) AS code FROM lineitem WHERE l_linenumber <= 2),
        a AS (SELECT * FROM o WHERE doc_id NOT IN (SELECT doc_id FROM n) UNION ALL SELECT * FROM n)
        SELECT doc_id, count(*) AS rows, min(code) AS least, max(code) AS most FROM a GROUP BY 1""",
    "reprocess_guard_reason": """WITH r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN [] ELSE ['A' || (o_orderkey % 4), 'B' || (o_orderkey % 5)] END AS old,
                          CASE WHEN o_orderkey % 4 = 1 THEN [] ELSE ['A' || (o_orderkey % 6), 'B' || (o_orderkey % 7)] END AS new FROM orders)
        SELECT k AS doc_id, CASE WHEN k % 10 = 0 THEN 'product_name_missing' WHEN len(old) > 0 AND len(new) > 0 AND NOT list_has_any(old, new) THEN 'ufi_mismatch' WHEN k % 3 = 0 THEN 'date_invalid' END AS reason FROM r""",
    "backfill_fill_nulls": f"{_BACKFILL_SQL} SELECT id, revision_date, version, codes, processing_status, changes, CASE WHEN NOT parsed THEN 'not_parsed' WHEN changes > 0 THEN 'changed' ELSE 'unchanged' END AS outcome FROM b",
    "backfill_totals": f"{_BACKFILL_SQL} SELECT CASE WHEN NOT parsed THEN 'not_parsed' WHEN changes > 0 THEN 'changed' ELSE 'unchanged' END AS outcome, count(*) AS documents, sum(changes)::BIGINT AS changes FROM b GROUP BY 1",
    "inventory_totals": f"{SUMMARY_SQL} SELECT count(*) AS chemicals, sum(total_documents)::BIGINT AS documents, count(current_id) AS with_current, count(*) - count(current_id) AS without_current, sum(needs_review_count)::BIGINT AS needs_review FROM summary",
    "manufacturer_share": f"WITH {CHEMICALS_SQL} SELECT coalesce(nullif(trim(manufacturer), ''), '(none)') AS manufacturer, count(*) AS chemicals, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM chemicals) AS share FROM chemicals GROUP BY 1",
    "status_report": f"{SUMMARY_SQL} SELECT coalesce(d.processing_status, 'no_sds') AS processing_status, count(*) AS chemicals FROM summary s LEFT JOIN documents_ d ON d.id = s.current_id GROUP BY 1",
    "recent_top10": f"{SUMMARY_SQL} SELECT s.id AS chemical_id, current_id, d.uploaded_at FROM summary s JOIN documents_ d ON d.id = s.current_id ORDER BY d.uploaded_at DESC, current_id DESC LIMIT 10",
    "attention_list": f"{SUMMARY_SQL} SELECT id, needs_review_count, current_id FROM summary WHERE current_id IS NULL OR needs_review_count > 0",
    "review_queue": f"WITH {CHEMICALS_SQL}, {DOCUMENTS_SQL} SELECT chemical_id, d.id, product_name, manufacturer FROM documents_ d JOIN chemicals c ON c.id = d.chemical_id WHERE processing_status = 'needs_review'",
    "search_any_field": f"WITH {CHEMICALS_SQL} SELECT c.id, product_name, manufacturer FROM chemicals c JOIN customer ON c_custkey = c.id WHERE contains(lower(product_name), 'maker 1') OR contains(lower(manufacturer), 'maker 1') OR contains(lower(internal_code), 'maker 1') OR contains(lower(c_mktsegment), 'maker 1')",
    "eligible_filter": f"{SUMMARY_SQL} SELECT id, current_id FROM summary WHERE current_id IS NOT NULL AND lower(trim(product_name)) NOT IN ('string', 'test', 'test product', 'test manufacturer') AND lower(trim(manufacturer)) NOT IN ('string', 'test', 'test product', 'test manufacturer')",
    "chemical_row_status": f"{SUMMARY_SQL} SELECT id, CASE WHEN needs_review_count > 0 THEN 'review' WHEN current_id IS NULL THEN 'empty' ELSE 'ready' END AS state FROM summary",
    "status_label_map": f"WITH {DOCUMENTS_SQL} SELECT id, CASE WHEN id % 9 = 0 THEN '—' WHEN processing_status = 'needs_review' THEN 'İnceleme Gerekli' WHEN processing_status = 'sections_extracted' THEN 'Bölümler Çıkarıldı' ELSE processing_status END AS label FROM documents_",
    "props_json_extract": "SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k_sum, count(*) AS events FROM events GROUP BY 1",
}
