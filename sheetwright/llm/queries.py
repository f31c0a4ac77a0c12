"""The registered queries of the llm operators: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sheetwright.llm.secret_scan import scan_secrets

    return scan_secrets(_table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sheetwright.llm.jaccard import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sheetwright.llm.topk import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), every=20, k=20)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sheetwright.llm.toxicity import fit, score

    docs = _table(spark, sf_dir, "documents")
    return score(docs, fit(docs, _table(spark, sf_dir, "labels")))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sheetwright.llm.warc import round_trip

    return round_trip(_table(spark, sf_dir, "pages"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sheetwright.llm.chat import render

    return render(_table(spark, sf_dir, "conversations"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sheetwright.llm.sharding import shard

    return shard(_table(spark, sf_dir, "documents"), shards=8)


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sheetwright.llm.url_filter import judge_urls

    return judge_urls(_table(spark, sf_dir, "pages"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sheetwright.llm.mixing import sampled

    return sampled(_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sheetwright.llm.decontaminate import find_leaks

    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sheetwright.llm.clustering import cluster

    return cluster(_table(spark, sf_dir, "embeddings"), k=16, rounds=3, width=64)


def op12_source_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sheetwright.llm.divergence import audit

    return audit(_table(spark, sf_dir, "documents"), least=3, top=200)


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sheetwright.llm.quality import judge

    return judge(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_secret_scans": op1_secret_scans,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_exact_topk": op3_exact_topk,
    "op4_toxicity": op4_toxicity,
    "op5_warc": op5_warc,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_sharding": op7_sharding,
    "op8_url_filters": op8_url_filters,
    "op9_mixing": op9_mixing,
    "op10_decontamination": op10_decontamination,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_source_divergence_audit": op12_source_divergence_audit,
    "op13_quality_rules": op13_quality_rules,
}

ORACLE_SQL = {
    "op6_chat_formatting": """
        WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place,
                          '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS line
                   FROM conversations WHERE conv_id IS NOT NULL),
        p AS (SELECT conv_id, place, list(line) OVER (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS so_far,
                     count(*) OVER (PARTITION BY conv_id) AS turns FROM t),
        w AS (SELECT turns, so_far, min(conv_id) AS conv_id, count(*) AS copies FROM p WHERE place = turns GROUP BY ALL),
        k AS (SELECT * FROM w WHERE so_far NOT IN (SELECT so_far FROM p WHERE place < turns))
        SELECT conv_id, turns, copies, array_to_string(so_far, '') AS rendered, sha256(array_to_string(so_far, '')) AS sha256 FROM k""",
    "op5_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT payload_digest, min(page_id) AS first_page FROM p WHERE payload_bytes >= 100 GROUP BY ALL)
        SELECT page_id, payload_bytes, p.payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_page THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_page THEN first_page END AS refers_to, true AS intact
        FROM p LEFT JOIN f USING (payload_digest)""",
}


def _url_sql() -> str:
    from sheetwright.llm.url_filter import RULES, SOFT, SOFT_HITS, SOFT_WEIGHT, STRICT, STRICT_WEIGHT

    hit = lambda term: f"CAST(regexp_matches(low, '(^|[^a-z0-9]){term}([^a-z0-9]|$)') AS BIGINT)"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    cases = lambda pick: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{pick(v, h, p)}'" for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))) + " END"
    strict, soft = " + ".join(map(hit, STRICT)), " + ".join(map(hit, SOFT))
    score = " + ".join([f"{STRICT_WEIGHT} * ({strict})", *(f"{w} * {hit(t)}" for t, w in SOFT.items())])
    return f"""
        WITH u AS (SELECT page_id, translate(coalesce(url, ''), '{upper}', '{lower}') AS low,
                          translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{upper}', '{lower}') AS host,
                          regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
        c AS (SELECT *, {strict} AS strict_terms, {soft} AS soft_terms, {score} AS score FROM u)
        SELECT page_id, host, path, {cases(lambda v, h, p: h + p)} AS rule,
               coalesce({cases(lambda v, h, p: v)}, CASE WHEN strict_terms > 0 OR soft_terms >= {SOFT_HITS} AND score >= {SOFT_WEIGHT} THEN 'block' ELSE 'allow' END) AS verdict,
               strict_terms, soft_terms, score FROM c"""


ORACLE_SQL["op8_url_filters"] = _url_sql()


def _cluster_sql(k: int = 16, rounds: int = 3, width: int = 64) -> str:
    """Lloyd's rounds one after another, every vector against every centroid in whole numbers."""
    far = f"list_sum([(v.e[i] - c.e[i]) * (v.e[i] - c.e[i]) for i in range(1, {width + 1})])"
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS e FROM embeddings
               WHERE len(embedding) = {width} AND list_count(embedding) = {width} AND len([x for x in embedding if NOT isfinite(x)]) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), e) - 1 AS c, e FROM v WHERE vec_id IS NOT NULL QUALIFY c < {k})",
    ]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, vec_id, v.e AS e, c, {far} AS d FROM v, c{i} AS c QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)")
        if i < rounds:
            steps.append(f"""m{i} AS MATERIALIZED (SELECT c, list(m ORDER BY i) AS e FROM (SELECT c, i, CAST(floor_div AS BIGINT) AS m FROM
                (SELECT c, i, CASE WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END AS floor_div FROM (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM a{i}) GROUP BY ALL))) GROUP BY c)""")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m{i}.e, c{i}.e) AS e FROM c{i} LEFT JOIN m{i} USING (c))")
    return f"""
        WITH {", ".join(steps)}
        SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
               CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(k.e, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} AS k USING (c)"""


def _divergence_sql() -> str:
    """Each pair of sources over every kept term, those that neither holds included."""
    from sheetwright.llm.divergence import LOWER, TERM, UPPER

    share = "1 + 1000000000 * (n + 1) // (sum(n) OVER (PARTITION BY {by}) + count(*) OVER (PARTITION BY {by}))"
    return f"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
        t AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM d),
        k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 3),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM t GROUP BY ALL),
        e AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        p AS MATERIALIZED (SELECT *, {share.format(by="lang, source")} AS p FROM e),
        q AS (SELECT lang, term, {share.format(by="lang")} AS q FROM k),
        s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
              LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
              UNION ALL SELECT p.lang, p.source, 'term', p.term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE n > 0 AND p > q)
        SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM o QUALIFY part = 'pair' OR rank <= 200"""


def _quality_sql() -> str:
    from sheetwright.llm.quality import LEAST_DUP_LINES, LEAST_WORDS, MOST_REPEATED

    word = r"[^\x20\x09-\x0D]"
    return rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
        s AS (SELECT *, regexp_extract_all(text, '{word}+') AS words, [x for x in string_split(text, chr(10)) if regexp_matches(x, '{word}')] AS lines FROM d),
        w AS (SELECT r, unnest(words) AS a, generate_subscripts(words, 1) AS i FROM s),
        x AS (SELECT *, lead(a, 1) OVER (PARTITION BY r ORDER BY i) AS b, lead(a, 2) OVER (PARTITION BY r ORDER BY i) AS c FROM w),
        y AS (SELECT r, i FROM x WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, a, b, c) > 1),
        z AS (SELECT r, count(DISTINCT i + o) AS n_repeat_words FROM y, (VALUES (0), (1), (2)) AS v(o) GROUP BY r),
        f AS (SELECT doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                     len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines,
                     len([x for x in words if regexp_matches(x, '[^\x00-\x40\x5B-\x60\x7B-\x7F]')]) AS letter_words,
                     length(regexp_replace(text, '[^A-Z]', '', 'g')) AS upper, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters
              FROM s LEFT JOIN z USING (r))
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
               CAST(n_repeat_words AS BIGINT) AS n_repeat_words, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
               NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words OR 100 * n_symbols > 10 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
                    OR n_dup_lines >= {LEAST_DUP_LINES} AND 100 * n_dup_lines > 30 * n_lines OR 100 * letter_words < 80 * n_words OR 100 * upper > 60 * letters) AS kept
        FROM f"""


ORACLE_SQL |= {"op11_centroid_clustering": _cluster_sql(), "op12_source_divergence_audit": _divergence_sql(), "op13_quality_rules": _quality_sql()}
