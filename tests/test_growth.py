"""What must not grow: the times that a value is made, the rows of one task, the documents of one chemical in one task."""

from pyspark.sql import functions as F

from sheetwright.functions import layout, protection, structure, text
from sheetwright.functions.lexicon_sections import NOISE_LINES
from sheetwright.functions.pages import alternation
from sheetwright.operators import relational, sections
from sheetwright.plans import views


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_upper_case_is_made_once(spark):
    docs = spark.createDataFrame([(1, "safety data sheet")], "doc_id long, text string")
    for column in (sections.document_type(F.col("text")), sections.confidence(F.col("text"), F.create_map().cast("map<int,string>"))):
        assert _plan(docs.select(column.alias("out"))).count("upper(") == 1


def test_values_are_made_once(spark):
    docs = spark.createDataFrame([("a b",)], "text string")
    assert _plan(docs.select(text.collapsed(F.col("text")).alias("out"))).count("regexp_replace(") == 1
    assert _plan(docs.select(text.is_placeholder(text.collapsed(F.col("text"))).alias("out"))).count("regexp_replace(") == 2
    assert _plan(docs.select(structure.splits_repaired(F.upper("text")).alias("out"))).count("upper(") == 1
    lines = docs.select(F.split("text", "\n").alias("lines"))
    assert _plan(lines.select(layout.column_values(F.col("lines"), {"color": ["colour"]}).alias("out"))).count("regexp_extract(") == 2


def test_lines_of_section_8_are_made_once(spark):
    docs = spark.createDataFrame([("8.1 TWA 5 ppm",)], "eight string")
    assert protection.with_protection(docs, "eight").first().protection.exposure_limits == ["8.1 TWA 5 ppm"]
    assert _plan(protection.with_protection(docs, "eight")).count(f"(?iU)^{alternation(NOISE_LINES)}") == 2


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(views, "TASK_ROWS", 100)
    assert views.dealt(spark.range(5000), "id").rdd.getNumPartitions() == 50


def test_sift_lets_every_spelling_pass(spark):
    words = ["Sürüm", "İlk", "ısı", "K", "(a"]
    texts = ["ſürüm", "SÜRÜM", "ilk", "Ilk", "ILK", "ISI", "K", "k", "(A"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert rows.where(F.col("t").rlike("(?iu)^" + text.sifted(words) + structure.quoted(words))).count() == len(texts)


def test_hot_chemicals_are_looked_up_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(relational, "CELL_ROWS", 50)
    docs = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 0, id) as chemical_id", "date_add(date'2020-01-01', int(id % 50)) as revision_date", "timestamp'2020-01-01' as uploaded_at", "id % 11 = 0 as is_current")
    found = relational.history(docs, hot=100, cells=4)
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    hot = [r.id for r in found.where("chemical_id = 0").orderBy("position").collect()]
    assert hot == [r.id for r in docs.where("chemical_id = 0").orderBy(F.desc("is_current"), F.desc("revision_date"), F.desc("id")).collect()]
