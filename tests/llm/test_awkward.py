"""Awkward inputs, session settings and shared folders of the llm operators."""

import re

import pytest


def _settings(spark):
    return {k: v for k, v in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jsparkSession.conf().getAll()).items()}


def test_queries_leave_settings_alone(spark):
    from sheetwright.llm.queries import QUERIES

    before = _settings(spark)
    for name, query in QUERIES.items():
        query(spark, "/root/testdata/sf0.001").limit(3).count()
        assert _settings(spark) == before, name


def test_added_secret_kinds():
    """All kinds against plain regular expressions, in texts beyond ASCII too."""
    import random

    from sheetwright.llm.secret_scan import compiled, find_secrets

    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    others = [("AKIA[A-Z0-9]+", 16), ("[0-9a-f]+", 32), ("gh[pousr]_[A-Za-z0-9]+", 40), ("xox[abprs]-[A-Za-z0-9-]+", 15), ("-----BEGIN [A-Z ]*PRIVATE KEY-----", 0)]
    parts = ["password", "=", ":", " ", '"', "token", "AKIA", "ABCDEFGH", "0123456789abcdef", "f", "é", "ghp_", "x" * 40, "xoxb-", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "0" * 20, "\n"]
    rng, automata = random.Random(1), compiled()
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        want = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
        want += [(m.start(), k, m.end()) for k, (p, n) in enumerate(others, 1) for m in re.finditer(p, text) if len(m[0]) >= n]
        assert find_secrets(text, automata) == sorted(want)


def test_warc_record_ids(spark, tmp_path):
    """No two records share an id: not equal rows, not records of other archives."""
    from sheetwright.llm.warc import read_chunks, write_warc

    pages = spark.createDataFrame([(1, "u", "x" * 300)] * 3 + [(None, None, None)] * 2 + [(2, "v", "y" * 5000)], "page_id long, url string, html string")
    found = []
    for name in ("a", "b"):
        write_warc(pages, str(tmp_path / name), chunk=1000)
        found += [r.record for r in read_chunks(spark, str(tmp_path / name)).where("chunk_no = 0").collect()]
    assert len(found) == len(set(found)) == 12


def test_warc_without_broadcast(spark, monkeypatch):
    from sheetwright.llm import warc

    pages = spark.createDataFrame([(i, None, "page " * 50 + str(i % 3)) for i in range(12)], "page_id long, url string, html string")
    rows = lambda: sorted(tuple(r) for r in warc.round_trip(pages).collect())
    before = rows()
    monkeypatch.setattr(warc, "BROADCAST_ROWS", -1)
    assert rows() == before
    assert sum(r[3] == "revisit" for r in before) == 9


def test_chat_inputs(spark):
    """Empty tables, clashing columns, repeated turns, ties and a long text."""
    from sheetwright.llm.chat import render

    kind = "conv_id long, turn long, role string, text string, place int, turns int, h1 string, copies string"
    long = "w " * 300_000
    rows = [(1, 0, "user", long, 1, 1, "a", "b"), (2, 0, "user", long, 1, 1, "a", "b"), (2, 1, "bot", "", 1, 1, "a", "b"), (3, 5, "b", "x", 0, 0, None, None), (3, 5, "a", "x", 0, 0, None, None), (3, 5, "a", "x", 0, 0, None, None)]
    table = spark.createDataFrame(rows, kind)
    got = {r.conv_id: r for r in render(table).collect()}
    assert set(got) == {2, 3}
    assert got[2].turns == 2 and long in got[2].rendered
    assert got[3].rendered == "<|im_start|>a\nx<|im_end|>\n" * 2 + "<|im_start|>b\nx<|im_end|>\n"
    assert render(table.limit(0)).count() == 0


def test_url_inputs(spark):
    from sheetwright.llm.url_filter import judge_urls, vocabulary

    rows = [(None, "http://n.net/porn", "h", 1), (1, "http://n.net/" + "a/" * 100_000 + "poker-bet", "h", 1), (1, "http://n.net/free-win", "h", 1), (1, "http://n.net/free-win", "h", 1)]
    table = spark.createDataFrame(rows, "page_id long, url string, host string, score int")
    got = judge_urls(table).collect()
    assert [(r.page_id, r.verdict) for r in got] == [(None, "block"), (1, "block"), (1, "allow"), (1, "allow")]
    assert judge_urls(table.limit(0)).count() == 0
    terms = spark.createDataFrame([("Bad", 10), ("bad", 2), ("meh", 3), (None, 1), ("", 1), ("x", None)], "term string, weight int")
    strict, soft = vocabulary(terms)
    assert (strict, soft) == (("bad",), {"meh": 3})
    assert [r.verdict for r in judge_urls(spark.createDataFrame([(1, "a://bad"), (2, "a://meh"), (3, "a://porn")], "page_id long, url string"), strict=strict, soft=soft).collect()] == ["block", "allow", "allow"]


def test_columns_of_any_name(spark):
    """Columns that operators use inside stay the caller's."""
    from sheetwright.llm.decontaminate import without_leaks
    from sheetwright.llm.jaccard import deduplicated
    from sheetwright.llm.mixing import mixed
    from sheetwright.llm.toxicity import clean

    kind = "doc_id long, text string, lang string, source string, _items array<string>, _text string, items int, root long, cell string, chance double, tokens int, mix_cell string"
    docs = spark.createDataFrame([(1, "some words of a clean text that nobody minds " * 9, "en", "a", ["q"], "t", 3, 4, "c", 0.5, 6, "m")], kind)
    items = spark.createDataFrame([(1, "a test item that isn't there")], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    row = docs.first()
    for kept in (without_leaks(docs, items), deduplicated(docs), clean(docs, labels), mixed(docs, keep=1.0)):
        assert kept.columns == docs.columns
        assert kept.collect() == [row]


def test_hot_row_of_the_ring(spark):
    """One row repeated very often fills its shards without gaps, and its cell is ranked in parts."""
    from sheetwright.llm.sharding import shard

    docs = spark.range(12000).selectExpr("if(id % 3 = 0, 7, id) as doc_id", "'x' as text", "'c' as cell", "1 as rank")
    rows = shard(docs).collect()
    slots = [sorted(r.slot for r in rows if r.shard == s) for s in range(8)]
    assert all(s == list(range(1500)) for s in slots)


def test_no_folder_of_one_machine(spark, monkeypatch):
    """Away from a single machine an unset shared folder is an error."""
    from sheetwright.llm.common import shared_dir

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(Session())
