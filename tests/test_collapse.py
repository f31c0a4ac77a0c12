"""``ws_collapse`` against its SQL on texts of nothing but blanks, and on white space beyond ASCII."""

import duckdb

import __spark_entry__

TEXTS = [None, "", " ", " \n\t ", "a  b\n", "\x0ba\x0b", "a\xa0 b", "\xa0a\u3000", "\u2028a\x85", "\u2003", "\x1ca\x1c", " \f\ra\r\n\r\nb "]


def test_blank_texts_are_empty_not_null(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, __spark_entry__.queries()["ws_collapse"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == sorted(con.execute(__spark_entry__.oracle_sql()["ws_collapse"]).fetchall())
