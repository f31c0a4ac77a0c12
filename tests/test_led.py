"""Patterns that begin with plain classes find what plain alternations find, and facts read a text in upper case once."""

from pyspark.sql import functions as F

from sheetwright.functions import fragments, structure, text
from sheetwright.functions.lexicon import REVISION_LABELS
from sheetwright.functions.pages import alternation
from sheetwright.operators.facts import document_facts

LABELS = ["Sürüm", "İlk\\s+yayın", "Odou?r", "Revision(?!\\s+no)", "Revision\\s+date", "Revised?", "No\\.?"]
TEXTS = ["SÜRÜM 2 sürüm", "ılk YAYIN ilk  yayın", "odor Odour odo", "Revision no revision REVISION DATE", "ReviSe revised revi", "no. NO n", "ſürüm"]


def test_led_finds_what_an_alternation_finds(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    found = lambda pattern: F.regexp_extract_all("t", F.lit(f"(?iU){pattern}"), F.lit(0))
    for labels in (LABELS, LABELS + ["K"], REVISION_LABELS):
        for row in rows.select(found(text.led(labels)).alias("led"), found(alternation(labels)).alias("plain")).collect():
            assert row.led == row.plain


def test_texts_without_marks_are_cut_like_others(spark):
    pieces = ["Renk: a", "SECTION 3: b", "BÖLÜM 12 :", "ſection 4:", "see section 7", "2.1. x", "5 2.1 y", "1.2.3", "pH 7", "\tKoku", "  Viscosity", "DNELs", "Version", "rev  2.2  z"]
    texts = [a + gap + b + gap + c for a in pieces for b in pieces for c in pieces[:5] for gap in (" ", "  ", "\n", "")]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    every = F.regexp_replace("t", "(?iu)" + alternation(structure.LINE_ENDS), "\n$1$2")
    assert rows.where(structure.lines_marked(F.col("t")) != every).count() == 0
    assert rows.where(structure.lines_marked(F.col("t")).contains("\n2.1  y")).count() == 0
    plan = rows.select(structure.lines_marked(F.col("t"))).limit(1)._jdf.queryExecution().optimizedPlan().toString()
    assert structure.PLAIN_ENDS[:20] in plan


def test_long_groups_of_p_codes_are_joined(spark):
    numbers = list(range(301, 321))
    rows = spark.createDataFrame([("P" + " + ".join(map(str, numbers)) + ", + 400",), ("+ 351 P305 + P3511",)], "t string")
    got = [r.out for r in rows.select(fragments.joined_p_groups(F.col("t")).alias("out")).collect()]
    assert got == ["+".join(f"P{n}" for n in numbers) + ", + 400", "+ 351 P305 + P3511"]


def test_facts_make_the_upper_case_once(spark):
    docs = spark.createDataFrame([(1, "safety data sheet")], "doc_id long, text string")
    plan = document_facts(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("upper(regexp_replace(coalesce(") == 1
