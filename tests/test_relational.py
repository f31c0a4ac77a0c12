"""Relational operators on hand-made tables, and the registered queries."""

import datetime as dt
import random

from sheetwright import registry
from sheetwright.operators import relational as rel


def test_current_revision_is_the_fold(spark):
    rows = _uploads(random.Random(4), 600, 60)
    docs = spark.createDataFrame(rows, UPLOAD)
    got = {r.chemical_id: r.current_id for r in rel.current_revisions(docs).collect()}
    want = {}
    for i, chem, _, day, _, version in sorted(rows, key=lambda r: (r[2], r[0])):
        key = [int(x) for x in version.split(".")] if version and version != "x" else None
        if chem not in want:
            want[chem] = (i, day, key)
            continue
        _, d, k = want[chem]
        if d is not None and day is not None and (day > d or (day == d and key is not None and k is not None and key > k)):
            want[chem] = (i, day, key)
    assert got == {c: v[0] for c, v in want.items()}


def _uploads(rng, n, chemicals):
    rows = []
    for i in range(n):
        day = dt.date(2020, 1, rng.randint(1, 4)) if rng.random() < 0.8 else None
        rows.append((i, rng.randint(0, chemicals), dt.datetime(2021, 1, rng.randint(1, 28)), day, None, rng.choice([None, "1.0", "1.2", "2", "x"])))
    return rows


UPLOAD = "id long, chemical_id long, uploaded_at timestamp, revision_date date, preparation_date date, version string"


def test_current_revision_of_a_stream(spark, tmp_path):
    """Any split of the uploads, in any order, and a restart between them, come to what a batch finds."""
    from sheetwright.streaming.current import current_table, follow_current

    rng = random.Random(9)
    rows = _uploads(rng, 300, 40)
    rng.shuffle(rows)
    want = {r.chemical_id: r.current_id for r in rel.current_revisions(spark.createDataFrame(rows, UPLOAD)).collect()}
    root, state = str(tmp_path / "store"), str(tmp_path / "state")
    assert current_table(spark, root).count() == 0
    cuts = [0, *sorted(rng.sample(range(300), 4)), 300]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        spark.createDataFrame(rows[a:b], UPLOAD).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{i}"))
        if i in (1, 4):  # what has come so far, file by file
            stream = spark.readStream.schema(UPLOAD).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            follow_current(stream, root, state).awaitTermination(120)
    assert {r.chemical_id: r.current_id for r in current_table(spark, root).collect()} == want


def test_history_of_a_hot_chemical(spark):
    """Two-phase ranks are those of one window, and no cell holds most of a hot chemical."""
    rng = random.Random(2)
    rows = [(i, rng.choice([1, 1, 1, 2, 3, None]), dt.datetime(2021, 1, rng.randint(1, 3)) if rng.random() < 0.9 else None, dt.date(2020, 1, rng.randint(1, 3)) if rng.random() < 0.7 else None, rng.choice([True, False, False, None])) for i in range(900)]
    docs = spark.createDataFrame(rows, "id long, chemical_id long, uploaded_at timestamp, revision_date date, is_current boolean")
    plain = {r.id: r.position for r in rel.history(docs).collect()}
    got = rel.history(docs, hot=50, cells=8)
    assert {r.id: r.position for r in got.collect()} == plain
    key = lambda r: (not r[4], -(r[3].toordinal() if r[3] else 0), -(r[2].timestamp() if r[2] else 0), -r[0])
    for chem in (1, 2, 3, None):
        mine = sorted((r for r in rows if r[1] == chem), key=key)
        assert [plain[r[0]] for r in mine] == list(range(1, len(mine) + 1))
    assert got.columns == [*docs.columns, "position"]
    assert rel.history(docs.limit(0), hot=1).count() == 0


def test_match_by_one_join(spark):
    """Every way in its order, duplicates, missing values; the parsed rows are shuffled once."""
    chemicals = spark.createDataFrame([(1, "Acid", "Acme", "A1"), (2, "acid ", "Other", None), (3, "Base", None, "B1"), (0, "Base", "Acme", "A1")], "id long, product_name string, manufacturer string, internal_code string")
    ufis = spark.createDataFrame([(2, "AAAA"), (1, " aaaa"), (3, None)], "chemical_id long, identifier_value string")
    kind = "doc_id long, ufi string, product_name string, manufacturer string, product_code string, tmp_0 string"
    parsed = spark.createDataFrame([(1, "aaaa ", "Base", "x", "y", "k"), (2, "zzzz", " ACID", "acme", None, "k"), (2, None, "Nothing", "ACME", "a1", "k"), (3, None, "base", None, None, "k"), (4, "", None, None, " ", "k"), (5, "", "Unknown", "Acme", None, "k")], kind)
    out = rel.matched_chemicals(parsed, chemicals, ufis)
    assert out.columns == [*parsed.columns, "chemical_id", "matched_by"]
    got = sorted((r.doc_id, r.chemical_id if r.chemical_id is not None else -1, str(r.matched_by), r.tmp_0) for r in out.collect())
    assert got == [(1, 1, "ufi", "k"), (2, 0, "code", "k"), (2, 1, "name_maker", "k"), (3, 0, "name", "k"), (4, -1, "None", "k"), (5, -1, "None", "k")]


def test_turkish_order(spark):
    from sheetwright.operators.reports import manufacturer_report

    words = ["zar", "Üzüm", "un", "Şeker", "su", "Öz", "oda", "inci", "ışık", "Demir", "Çam", "cam", "ağ"]
    rows = [(w,) for w in words] + [("zar",), (None,), (" ",), ("  zar ",)]
    got = [(r.position, r.manufacturer, r.chemicals) for r in manufacturer_report(spark.createDataFrame(rows, "manufacturer string")).orderBy("position").collect()]
    assert got == list(zip(range(1, 15), ["zar", "Üretici bilgisi yok", "ağ", "cam", "Çam", "Demir", "ışık", "inci", "oda", "Öz", "su", "Şeker", "un", "Üzüm"], [3, 2] + [1] * 12, strict=True))


def test_insert_if_absent_and_replace(spark):
    have = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, code string")
    new = spark.createDataFrame([(1, "a"), (1, "c"), (1, "c")], "doc_id long, code string")
    assert sorted(map(tuple, rel.missing_rows(new, have, ["doc_id", "code"]).collect())) == [(1, "c")]
    assert sorted(map(tuple, rel.replaced_rows(have, new, "doc_id").collect())) == [(1, "a"), (1, "c"), (1, "c"), (2, "b")]


def test_registry(spark):
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
    assert registry.FLAGSHIP(spark, "/root/testdata/sf0.001").count() > 0


def test_entry():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_stream(spark, tmp_path):
    from sheetwright.sources.render import rendered
    from sheetwright.streaming.ingest import document_stream, ingest

    docs = rendered(spark, "/root/testdata/sf0.001").limit(5)
    docs.union(docs).repartition(2).write.parquet(str(tmp_path / "in"))
    query = ingest(document_stream(spark, str(tmp_path / "in"), docs.schema), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_search_by_trigrams(spark):
    """What contains finds, in any field, with Turkish letters; candidates are few where a term has a rare trigram."""
    from sheetwright.functions.text import lower_tr
    from sheetwright.operators import search

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcIİıiŞş ") for _ in range(rng.randint(0, 9)))
    rows = [(i, word(), word() if i % 5 else None) for i in range(150)] + [(900 + i, f"common text {i}", "zzz rare") for i in range(3)]
    chemicals = spark.createDataFrame(rows, "id long, a string, b string")
    terms = spark.createDataFrame([(word()[:4],) for _ in range(60)] + [("common rare",), ("RARE",), ("x t",), (" ",), (None,), ("none such",)], "term string")
    got = {tuple(r) for r in search.search_terms(chemicals, terms, ["a", "b"], search.postings(chemicals, ["a", "b"])).collect()}
    lowered = {r.t: r.low for r in terms.where("term is not null").selectExpr("term as t").withColumn("low", lower_tr("t")).collect()}
    texts = chemicals.selectExpr("id", "coalesce(a, '') as a", "coalesce(b, '') as b").withColumns({c: lower_tr(c) for c in "ab"}).collect()
    want = {(t, r.id) for t, low in lowered.items() for r in texts if low.strip(" ") and (low.strip(" ") in r.a or low.strip(" ") in r.b)}
    assert got == want
    few = search.candidates(search.postings(chemicals, ["a", "b"]), terms.where("term = 'RARE'"))
    assert few.count() == 3
