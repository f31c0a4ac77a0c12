"""Decontamination with a benchmark of more than one block."""


def test_one_block_at_a_time(spark, monkeypatch):
    from sheetwright.llm import decontaminate

    items = spark.createDataFrame([(i, f"item number {i} of the benchmark, long enough to be told apart: {'abcdefghij'[i] * 9}") for i in range(10)], "item_id long, text string")
    docs = items.selectExpr("item_id as doc_id", "concat('see ', text) as text").union(spark.createDataFrame([(99, "clean"), (None, None)], "doc_id long, text string"))
    want = sorted(map(str, decontaminate.find_leaks(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 300)
    got = decontaminate.find_leaks(docs, items)
    assert sorted(map(str, got.collect())) == want
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 0
    assert decontaminate.without_leaks(docs, items).count() == 2
