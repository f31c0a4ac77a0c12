"""How far the sources of a language differ in the words they use, audited in shards by DuckDB.

Tasks count terms of their documents with SQL in DuckDB; Spark sums the counts. Rows are then hashed by language and
term into shards of bounded rows, so a shard holds all sources of its terms, and two SQL statements run in each: one
drops rare terms and adds the language's own counts, the other makes partial sums for pairs of sources and each
source's best terms. Spark merges sums and rankings.

A term that neither source of a pair holds adds the same constant, and a term that one of them holds adds an amount
that depends on one count alone. So a shard only meets sources that share a term:

    sum over all terms = sum over shared terms of (f(p, q) - f(p, q0) - f(p0, q) + f0)
                       + sum over the source's terms of f(p, q0) + sum over the other's of f(p0, q)
                       + (V - n - m) f0

with p0 and q0 the shares of a term with no count, f0 = f(p0, q0), and n and m the numbers of terms held. The second
line comes from histograms of shares. All of it is whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheetwright.llm.common import on_table, saved

#: Characters of a term: ASCII letters and all that is beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCALE = 1_000_000_000
#: Bytes of text counted in one statement, rows of partial counts that a task merges at a time, rows of a shard, tasks
#: in which a language's histograms meet its sources, and parts in which a source's best terms are ranked first.
PIECE, MERGE_ROWS, SHARD_ROWS, SALTS, PARTS = 4 << 20, 400_000, 250_000, 16, 32
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _session():
    """A DuckDB of one thread that never writes to disk."""
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})


def _run(con, sql: str, **tables: pa.Table) -> pa.Table:
    for name, table in tables.items():
        con.register(name, table)
    out = con.sql(sql).to_arrow_table()
    for name in tables:
        con.unregister(name)
    return out


_SPLIT = f"SELECT doc, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM t"
_PER_DOC = f"SELECT doc, term, count(*) AS n FROM ({_SPLIT}) GROUP BY ALL"
_MERGED = "SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, CAST(sum(docs) AS BIGINT) AS docs FROM c GROUP BY ALL"


def _pieces(text: str) -> Iterator[str]:
    """A long text in parts of about PIECE characters; each ends behind an ASCII character that no term holds."""
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text) and (text[end - 1] > "\x7f" or text[end - 1].isalpha()):
            end += 1
        yield text[at:end]
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of a partition's documents, merged as they come."""
    con = _session()
    held: list[pa.Table] = []

    def counted(rows: pa.Table) -> pa.Table:
        return _run(con, f"SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, count(*) AS docs FROM ({_PER_DOC}) JOIN t USING (doc) GROUP BY ALL", t=rows).cast(_COUNTS)

    def long_one(text: str, lang: str, source: str) -> pa.Table:
        parts = [_run(con, _PER_DOC, t=pa.table({"doc": [0], "text": [p]})) for p in _pieces(text)]
        whole = _run(con, "SELECT term, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY ALL", c=pa.concat_tables(parts))
        size = len(whole)
        return pa.table([pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), whole["term"], whole["n"], pa.array([1] * size, pa.int64())], schema=_COUNTS)

    for batch in batches:
        lang, source, text = (c.cast(pa.string()) for c in batch.columns)
        sizes = pc.binary_length(text).to_numpy(zero_copy_only=False)
        at = 0
        while at < len(text):
            end, held_bytes = at, 0
            while end < len(text) and (end == at or held_bytes + sizes[end] <= PIECE):
                held_bytes += int(sizes[end])
                end += 1
            if held_bytes > PIECE:
                held.append(long_one(text[at].as_py(), lang[at].as_py(), source[at].as_py()))
            elif held_bytes:
                held.append(counted(pa.table({"doc": pa.array(range(end - at), pa.int64()), "lang": lang[at:end], "source": source[at:end], "text": text[at:end]})))
            at = end
        if sum(map(len, held)) > MERGE_ROWS:
            held = [_run(con, _MERGED, c=pa.concat_tables(held)).cast(_COUNTS)]
            if len(held[0]) > MERGE_ROWS // 2:
                yield from held.pop().to_batches(max_chunksize=50_000)
    if held:
        yield from _run(con, _MERGED, c=pa.concat_tables(held)).cast(_COUNTS).to_batches(max_chunksize=50_000)


_KEPT = """
    SELECT lang, source, term, n, CAST(lang_n AS BIGINT) AS lang_n, row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1 AS leads, shard
    FROM c JOIN (SELECT lang, term, sum(n) AS lang_n FROM c GROUP BY ALL HAVING sum(docs) >= {least}) USING (lang, term)"""


def _common_terms(table: pa.Table, least: int) -> pa.Table:
    kind = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("lang_n", pa.int64()), ("leads", pa.bool_()), ("shard", pa.int32())])
    return _run(_session(), _KEPT.format(least=int(least)), c=table).cast(kind)


_F = "CAST((({p}) - ({q})) AS HUGEINT) * (({p}) - ({q})) // ({q})"
_PAIRS = f"""
    SELECT a.lang, a.source, b.source AS item,
           CAST(sum({_F.format(p="a.p", q="b.p")} - {_F.format(p="a.p", q="b.p0")} - {_F.format(p="a.p0", q="b.p")} + {_F.format(p="a.p0", q="b.p0")}) AS DECIMAL(38, 0)) AS value,
           'pair' AS part
    FROM c a JOIN c b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source"""
_TERMS = f"""
    SELECT lang, source, term AS item, CAST({_F.format(p="p", q="lang_p")} AS DECIMAL(38, 0)) AS value, 'term' AS part
    FROM c WHERE p > lang_p QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, term) <= {{top}}"""
_SHARES = "SELECT lang, source, CAST(p AS VARCHAR) AS item, CAST(count(*) AS DECIMAL(38, 0)) AS value, 'share' AS part FROM c GROUP BY ALL"
_SHARD = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.decimal128(38, 0)), ("part", pa.string())])


def _audit(table: pa.Table, top: int) -> pa.Table:
    """A shard's partial sums for pairs of sources that share a term, each source's best terms, and its histogram of shares."""
    con = _session()
    return pa.concat_tables([_run(con, sql, c=table).cast(_SHARD) for sql in (_PAIRS, _TERMS.format(top=int(top)), _SHARES)])


def _wide(x: Column) -> Column:
    return x.cast("decimal(38,0)")


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE (n + 1) / (total + terms)), in whole numbers; null where there are no terms."""
    up, down = _wide(n + F.lit(1)) * F.lit(SCALE), _wide(total + terms)
    return F.when(terms > 0, (F.call_function("div", _wide(up), down) + 1).cast("long"))


def _excess(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q): shares are at most SCALE + 1, so squares fit in 64 bits."""
    return _wide(F.call_function("div", (p - q) * (p - q), q))


def audit(docs: DataFrame, least: int = 3, top: int = 200, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """Divergence of each source from the others of its language, and the terms that set it apart.

    lang, source, part, item, value, rank. Terms are runs of ASCII letters (A-Z as a-z) and characters beyond ASCII;
    each language keeps those that at least ``least`` of its documents (rows) hold, V in number. A source, and the
    language as a whole, gives each kept term the share 1 + floor(10^9 (count + 1) / (N + V)), N its occurrences of kept
    terms. f is floor((p - q)^2 / q). Part ``pair``: for each other source of the language the sum of f over all kept
    terms (0 if there are none), p the source's share and q the other's. Part ``term``: for kept terms that the source
    holds with a larger share than the language's, f with q the language's, the ``top`` highest. Ranks count from 1 by
    value, ties by the item's UTF-8 bytes.

    Null lang, source and text count as empty. Rows that repeat are documents each. A (lang, source) without terms is
    a source like any other. A very long text is counted in pieces cut between terms. An empty table gives an empty
    result; other columns are ignored. Pairs are as many as the sources of a language allow: the result asks for them.
    """
    empty = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    rows = docs.select(empty(lang).alias("lang"), empty(source).alias("source"), empty(text).alias("text"))
    groups = rows.select("lang", "source").distinct()
    summed = rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = saved(summed, "counts")
    shards = -(-counts.count() // SHARD_ROWS) or 1
    dealt = counts.withColumn("shard", F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int"))
    run = on_table(_common_terms, least=least)
    kept = saved(dealt.groupBy("shard").applyInArrow(run, "lang string, source string, term string, n long, lang_n long, leads boolean, shard int"), "kept")

    # Totals: one row for each (lang, source), and for each language.
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("held"))
    once = kept.where("leads").groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    named = groups.join(own, ["lang", "source"], "left").join(once, "lang", "left").fillna(0, ["total", "held", "terms", "lang_total"])
    totals = saved(named.withColumn("p0", _share(F.lit(0).cast("long"), F.col("total"), F.col("terms"))), "totals")

    # A source may hold most rows: it meets its totals in SALTS tasks where they aren't broadcast by Spark's own check of their size.
    salted = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")
    shared = kept.withColumn("salt", salt).join(salted.select("lang", "source", "salt", "total", "terms", "lang_total", "p0"), ["lang", "source", "salt"])
    shared = shared.select("lang", "source", "term", "shard", _share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), "p0", _share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("lang_p"))
    found = saved(shared.groupBy("shard").applyInArrow(on_table(_audit, top=top), "lang string, source string, item string, value decimal(38,0), part string"), "shards")

    # Histograms of shares: what a term of one source alone adds to its pairs.
    rare = found.where("part = 'share'").groupBy("lang", "source", F.col("item").cast("long").alias("p")).agg(_wide(F.sum("value")).alias("n")).withColumn("salt", F.pmod(F.xxhash64("source", "p"), F.lit(SALTS)).cast("int"))
    other = salted.select("lang", F.col("source").alias("item"), "salt", F.col("p0").alias("q0"))
    alone = rare.join(other, ["lang", "salt"]).where("source <> item")
    alone = alone.select("lang", "source", "item", (_excess(F.col("p"), F.col("q0")) * F.col("n")).cast("decimal(38,0)").alias("there"), (_excess(F.col("q0"), F.col("p")) * F.col("n")).cast("decimal(38,0)").alias("back"))
    sums = alone.groupBy("lang", "source", "item").agg(_wide(F.sum("there")).alias("there"), _wide(F.sum("back")).alias("back"))
    second = totals.select("lang", F.col("source").alias("item"), F.col("held").alias("item_held"), F.col("p0").alias("q0"))
    base = totals.join(second, "lang").where("source <> item")  # a row of the result each
    base = base.select("lang", "source", "item", F.coalesce(_wide(_excess(F.col("p0"), F.col("q0")) * (F.col("terms") - F.col("held") - F.col("item_held"))), _wide(F.lit(0))).alias("value"))
    parts = found.where("part = 'pair'").select("lang", "source", "item", "value")
    parts = parts.unionByName(sums.select("lang", "source", "item", F.col("there").alias("value")))
    parts = parts.unionByName(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value"))).unionByName(base)
    pairs = parts.groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))

    order = (F.desc("value"), F.asc("item"))
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))
    terms = found.where("part = 'term'").select("lang", "source", "item", F.col("value").cast("long").alias("value"), F.pmod(F.xxhash64("item"), F.lit(PARTS)).alias("cell"))
    terms = terms.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "cell").orderBy(*order))).where(F.col("rank") <= top)
    terms = terms.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))).where(F.col("rank") <= top)
    shown = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return shown(pairs, "pair").unionByName(shown(terms, "term"))
